"""Vector search: exact, by blocks.

Queries and corpus are cut into blocks of bounded size, every pair of blocks is one
matrix product in numpy, and only the best k of each query and block are shuffled.
So the work of a stated query set against all rows spreads over all tasks, and
neither side is broadcast or collected.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions import text as T
from taleweave.operators.best import Best, plain

QUERY_BLOCK, CORPUS_BLOCK = 512, 8_192


def _blocks(df: DataFrame, key: str, vector: str, size: int, name: str, n: int | None, label: str | None = None) -> DataFrame:
    """(<name>_rows): arrays of about size rows each. n: the number of rows, if known."""
    held = df.filter(F.col(vector).isNotNull())
    n = max(1, -(-(held.count() if n is None else n) // size))
    rows = held.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("b"), F.struct(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), *([F.col(label).cast("long").alias("label")] if label else [])).alias("r"))
    return rows.groupBy("b").agg(F.collect_list("r").alias(f"{name}_rows")).select(f"{name}_rows")


def _matrix(column, i: int, metric: str):
    """(ids, vectors) of one block of a batch, without Python objects."""
    rows = column[i].values
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    lists = rows.field("v")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(ids), -1)
    if metric == "cosine":
        n = np.sqrt((v * v).sum(1, keepdims=True))
        v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    return ids, v


def _best(k: int | None, metric: str, least: float | None = None):
    def run(batches):
        for b in batches:
            out = []
            for r in range(b.num_rows):
                qi, q = _matrix(b.column(0), r, metric)
                ci, c = _matrix(b.column(1), r, metric)
                if metric == "cosine":
                    s = q @ c.T
                else:
                    s = -np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * q @ c.T))
                s = np.round(s, 6)
                for i in range(len(qi)):
                    if least is not None:
                        top = np.flatnonzero(s[i] >= least)
                    else:
                        # all rows of the k-th best score stay in, so that ties go by id
                        few = np.arange(len(ci)) if len(ci) <= k else np.flatnonzero(s[i] >= np.partition(s[i], -k)[-k])
                        top = few[np.lexsort((ci[few], -s[i][few]))[:k]]
                    out.append(pa.table({"query_id": np.full(len(top), qi[i]), "id": ci[top], "score": s[i][top]}))
            if out:
                yield from pa.concat_tables(out).to_batches()

    return run


def _pairs(queries, corpus, query_key, key, vector, n_queries, n_corpus, label=None) -> DataFrame:
    """All pairs of a block of queries and a block of the corpus: blocks, not rows."""
    q = _blocks(queries, query_key, vector, QUERY_BLOCK, "q", n_queries, label)
    return q.crossJoin(_blocks(corpus, key, vector, CORPUS_BLOCK, "c", n_corpus, label))


def within(queries: DataFrame, corpus: DataFrame, least: float, query_key: str, key: str, vector: str = "embedding", metric: str = "cosine", n_queries: int | None = None, n_corpus: int | None = None) -> DataFrame:
    """(query_id, id, score): every row with a score of at least the threshold."""
    pairs = _pairs(queries, corpus, query_key, key, vector, n_queries, n_corpus)
    return pairs.mapInArrow(_best(None, metric, least), "query_id long, id long, score double")


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_key: str, key: str, vector: str = "embedding", metric: str = "cosine", n_queries: int | None = None, n_corpus: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest rows; score is the cosine, or the
    negative distance for l2, to 6 digits, ties by id. Null vectors match nothing."""
    best = _pairs(queries, corpus, query_key, key, vector, n_queries, n_corpus).mapInArrow(_best(k, metric), "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mmr_order(vectors: np.ndarray, relevance: np.ndarray, k: int, trade: float) -> list[int]:
    """Greedy maximal marginal relevance: indexes in the order of choice."""
    chosen: list[int] = []
    left = list(range(len(relevance)))
    near = np.zeros(len(relevance))
    while left and len(chosen) < k:
        gain = np.round([trade * relevance[i] - (1 - trade) * near[i] for i in left], 9)
        i = left.pop(int(np.argmax(gain)))
        near = np.maximum(near, vectors @ vectors[i]) if chosen else vectors @ vectors[i]
        chosen.append(i)
    return chosen


def mmr(candidates: DataFrame, k: int, trade: float = 0.5) -> DataFrame:
    """(query_id, id, rank) of candidates (query_id, id, score, embedding). A group is
    the bounded candidate pool of one query."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        v = np.array(g["embedding"].tolist(), dtype=np.float64)
        v = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
        order = mmr_order(v, g["score"].to_numpy(), k, trade)
        return pd.DataFrame({"query_id": g["query_id"].iloc[0], "id": g["id"].iloc[order].to_numpy(), "rank": range(1, len(order) + 1)})

    return candidates.groupBy("query_id").applyInPandas(run, "query_id long, id long, rank int")


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, mean, n): one row per dimension, averaged before the shuffle."""
    return df.select(F.col(group).alias("grp"), F.posexplode(vector).alias("dim", "x")).groupBy("grp", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))


def hash_embeddings(df: DataFrame, key: str, text: str = "text", dims: int = 256) -> DataFrame:
    """(id, embedding): offline stand-in for an embedding model, counts of lower-case
    words by crc32 modulo dims, to length 1; texts without words are zero vectors. Words
    are split and hashed in the JVM, a batch is counted at once."""

    def run(batches):
        for b in batches:
            lists = b.column(1)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            m = np.bincount(row * dims + flat, minlength=b.num_rows * dims).reshape(b.num_rows, dims).astype(np.float64)
            n = np.sqrt((m * m).sum(1, keepdims=True))
            m = np.divide(m, n, out=m, where=n > 0)
            out = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dims, pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["id", "embedding"])

    buckets = F.transform(T.words(F.col(text)), lambda w: (F.crc32(w) % dims).cast("int"))
    return df.select(F.col(key).cast("long").alias("id"), buckets.alias("b")).mapInArrow(run, "id long, embedding array<double>")


class Hashed:
    """Scores batches (id, w) by the cosine of their hashed words with those of questions
    (id, w), as top_k does hash_embeddings, and keeps the k best. Products of counts are
    whole numbers, exact in single precision up to 2**24 and else taken in double; the
    scores of those that may stay are taken in double."""

    BLOCK = 512

    def __init__(self, questions: pa.Table, k: int, dims: int = 256):
        self.k, self.dims, self.queries = k, dims, plain(questions.column("id"))
        self.q, self.norm = self._counts(plain(questions.column("w")))

    def _counts(self, lists) -> tuple[np.ndarray, np.ndarray]:
        words = lists.flatten().dictionary_encode()
        bucket = np.array([zlib.crc32(w.encode()) % self.dims for w in words.dictionary.to_pylist()], dtype=np.int64)
        n = len(lists)
        row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        m = np.bincount(row * self.dims + bucket[words.indices.to_numpy(zero_copy_only=False)], minlength=n * self.dims).reshape(n, self.dims) if len(words) else np.zeros((n, self.dims))
        m = m.astype(np.float64)
        return m, np.sqrt((m * m).sum(1))

    def start(self) -> None:
        self.best = Best(len(self.queries), self.k)

    def add(self, batch: pa.RecordBatch) -> None:
        if self.k <= 0 or not len(self.queries) or not batch.num_rows:
            return
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        c, norm = self._counts(batch.column(1))
        exact = np.float32 if self.norm.max() * norm.max() < 2**24 else np.float64
        c, inverse = np.ascontiguousarray(c.T, dtype=exact), np.divide(1, norm, out=np.zeros_like(norm), where=norm > 0).astype(exact)
        for at in range(0, len(self.q), self.BLOCK):
            dot = self.q[at : at + self.BLOCK].astype(exact) @ c
            own = self.norm[at : at + self.BLOCK]
            # a rough comparison with room for single precision; all zero vectors score 0
            least = ((self.best.floor[at : at + self.BLOCK] - 1e-5) * own).astype(exact)
            least[own == 0] = -np.inf
            may = dot * inverse >= least[:, None]
            for j in np.flatnonzero(may.any(1)):
                few = np.flatnonzero(may[j])
                by = own[j] * norm[few]
                score = np.divide(dot[j, few].astype(np.float64), by, out=np.zeros(len(few)), where=by > 0)
                keep = np.round(score, 6) >= self.best.floor[at + j]
                if keep.any():
                    self.best.offer(at + j, score[keep], ids[few][keep])

    def rows(self, kind: pa.DataType):
        return self.best.batches([np.array([i]) for i in range(len(self.queries))], self.queries, kind)


def _tallied(thresholds: list[float]):
    def run(batches):
        for b in batches:
            n, kept, relevant, lost = 0, np.zeros(len(thresholds), np.int64), np.zeros(len(thresholds), np.int64), np.zeros(len(thresholds), np.int64)
            for r in range(b.num_rows):
                _, q = _matrix(b.column(0), r, "cosine")
                _, c = _matrix(b.column(1), r, "cosine")
                ql, cl = (b.column(k)[r].values.field("label").to_numpy(zero_copy_only=False) for k in (0, 1))
                s, same = np.round(q @ c.T, 6), ql[:, None] == cl[None, :]
                n += s.size
                for i, t in enumerate(thresholds):
                    over = s >= t
                    kept[i] += over.sum()
                    relevant[i] += (over & same).sum()
                    lost[i] += (~over & same).sum()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array(thresholds, dtype=np.float64), np.full(len(thresholds), n), kept, relevant, lost)], ["threshold", "n", "kept", "kept_relevant", "dropped_relevant"])

    return run


def calibration(queries: DataFrame, corpus: DataFrame, key: str, label: str, thresholds: list[float], vector: str = "embedding") -> DataFrame:
    """(threshold, kept, kept_relevant, dropped_relevant, kept_share) over all pairs of a
    query and a row, relevant where the labels are equal. Pairs are counted inside the
    product of two blocks; none leaves it."""
    pairs = _pairs(queries, corpus, key, key, vector, None, None, label)
    t = pairs.mapInArrow(_tallied(thresholds), "threshold double, n long, kept long, kept_relevant long, dropped_relevant long")
    g = t.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("n", "kept", "kept_relevant", "dropped_relevant")])
    return g.select("threshold", "kept", "kept_relevant", "dropped_relevant", F.round(F.col("kept") / F.col("n"), 6).alias("kept_share"))
