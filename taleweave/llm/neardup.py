"""Problem 5: near-duplicate records with small edits.

A token-group matrix. Equal normalised texts collapse to one representative. Every
text gets a sketch of its distinct 12-character substrings; its tokens are BANDS
signatures of ROWS minimum hashes each, of 64 bits with the number of the band.

1. Partition. Minimum hashes in their order are a path in a trie; a text belongs to
   the shortest prefix (2, 4, 8 hashes) that at most GROUP texts share, so like texts
   meet; a longer prefix that more share is salted into groups of that size.
2. Matrix. A group stores the union of the tokens of its members, once each.
3. Bound. Unions meet on their tokens, and a pair of groups with fewer than
   LEAST common tokens is rejected: no pair of members can have more. In what is
   left, every member is a query: the minimum hashes it has in common with the union
   of the other group bound those it has with any member of it, and the group is
   opened for it only from SCREEN of KEPT on.
4. In an opened group, the sizes and SCREEN matching minimum hashes bound each pair,
   and pairs left are decided on their whole substring sets.

By the tokens a pair at the threshold of 0.6 is missed with probability 0.0001, one at
0.65 with 4e-6, at 0.7 with 5e-8; by the minimum hashes 1 in 10 million. With
`exact=True` nothing is left to chance: the tokens are the prefix of the sorted
substrings that two texts of the threshold must share, and nothing is screened.

Every step is a shuffled join on a key that AQE splits when it is hot; groups are
bounded, and no cap is set on partners.

Defined results: rows without text have no pair; a null title counts as empty; a
text shorter than one substring has itself as its only one; equal rows are pairs of
similarity 1; repeated ids pair with others, not with themselves.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.operators.graph import components
from taleweave.session import cut, small_side

WIDTH, THRESHOLD = 12, 0.6
#: Tokens of a text, minimum hashes in one, tokens two texts must share.
BANDS, ROWS, LEAST = 48, 3, 2
#: Minimum hashes kept for the bounds, and how many must match (38 on average at the threshold).
KEPT, SCREEN = 64, 18
#: Texts of a group, on average at most.
GROUP = 32
DEPTHS = (2, 4, 8)

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], dtype=np.uint64)
_POWERS = tuple(np.array([pow(0x9E3779B97F4A7C15, k, 2**64)], dtype=np.uint64) for k in (1, 2, 4))
_MULTIPLIERS = np.random.default_rng(12).integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_BAND_SALT = np.random.default_rng(13).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_PATH_SALT = np.random.default_rng(14).integers(1, 2**63, DEPTHS[-1], dtype=np.uint64) | np.uint64(1)


def normal(title: str | None, text: str) -> str:
    return ((title or "") + text).lower().replace(" ", "").replace("\n", "").replace("\t", "").replace("\r", "")


def substrings(x: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the substrings of WIDTH characters."""
    a = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(a) < WIDTH:
        a = np.concatenate([a, np.zeros(WIDTH - len(a), dtype=np.uint64)])
    n = len(a) - WIDTH + 1
    # polynomials of 2, 4, 8 and then 12 characters from those of half the length
    m1, m2, m4 = _POWERS
    h2 = a[:-1] * m1 + a[1:]
    h4 = h2[:-2] * m2 + h2[2:]
    h8 = h4[:-4] * m4 + h4[4:]
    h = h8[:n] * m4 + h4[8 : 8 + n]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    return np.unique(h)


def sketch(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(band signatures, prefixes of the trie, the low bytes of KEPT minimum hashes)."""
    low = (grams >> np.uint64(16)).astype(np.uint32)
    least = np.full(len(_MULTIPLIERS), 0xFFFFFFFF, dtype=np.uint32)
    # in pieces that stay in the processor's cache, also for very long texts
    for i in range(0, len(low), 1024):
        part = low[None, i : i + 1024]
        for k in range(0, len(_MULTIPLIERS), 24):
            np.minimum(least[k : k + 24], (part * _MULTIPLIERS[k : k + 24, None]).min(1), out=least[k : k + 24])
    mixed = _mixed((least.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_SALT).sum(1, dtype=np.uint64))
    path = _mixed(np.cumsum(least[: DEPTHS[-1]].astype(np.uint64) * _PATH_SALT, dtype=np.uint64)[[d - 1 for d in DEPTHS]])
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32), path.view(np.int64), (least[:KEPT] >> np.uint32(13)).astype(np.uint8).tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = np.intersect1d(a, b, assume_unique=True).size
    return common / (len(a) + len(b) - common)


def prefix(grams: np.ndarray) -> np.ndarray:
    """The first of the sorted substrings: two texts at the threshold share one of them."""
    return grams[: len(grams) - math.ceil(THRESHOLD * len(grams) - 1e-9) + 1].view(np.int64)


_SKETCH = "id long, key binary, n int, tokens array<{}>, p0 long, p1 long, p2 long, sketch binary"


def _sketches(exact: bool):
    def run(batches):
        for b in batches:
            ids, titles, texts = (b.column(i).to_pylist() for i in range(3))
            keys, sizes, tokens, paths, sketches = [], [], [], [], []
            for title, text in zip(titles, texts):
                x = normal(title, text)
                g = substrings(x)
                t, p, s = sketch(g)
                keys.append(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                sizes.append(len(g))
                tokens.append(prefix(g) if exact else t)
                paths.append(p)
                sketches.append(s)
            kind = np.int64 if exact else np.int32
            flat = pa.array(np.concatenate(tokens) if tokens else np.zeros(0, kind))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32()), flat)
            path = np.array(paths, dtype=np.int64).reshape(-1, len(DEPTHS))
            columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), lists, *(pa.array(path[:, k].copy()) for k in range(len(DEPTHS))), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "n", "tokens", "p0", "p1", "p2", "sketch"])

    return run


def _grouped(docs: DataFrame) -> DataFrame:
    """Adds g, the group of a text: the shortest prefix that at most GROUP texts share."""
    counts = cut(docs.groupBy("p0", "p1", "p2").agg(F.count("*").alias("c2")))
    over1 = counts.groupBy("p0", "p1").agg(F.sum("c2").alias("c1"))
    over0 = counts.groupBy("p0").agg(F.sum("c2").alias("c0"))
    # only prefixes of more than GROUP texts are looked up
    big = [small_side(x.filter(f"{c} > {GROUP}")) for x, c in ((over0, "c0"), (over1, "c1"), (counts, "c2"))]
    x = docs.join(big[0], "p0", "left").join(big[1], ["p0", "p1"], "left").join(big[2], ["p0", "p1", "p2"], "left")
    salt = F.xxhash64("p2", F.pmod(F.xxhash64("id"), F.ceil(F.col("c2") / GROUP)))
    g = F.when(F.col("c0").isNull(), F.col("p0")).when(F.col("c1").isNull(), F.col("p1")).when(F.col("c2").isNull(), F.col("p2")).otherwise(salt)
    return x.withColumn("g", g).drop("c0", "c1", "c2", "p0", "p1", "p2")


def group_matrix(docs: DataFrame, exact: bool = False) -> DataFrame:
    """(g, ids, ns, sketches, tokens): members of each group and the union of their
    tokens. Tokens travel as they are and get the number of their band in the group."""
    x = _grouped(docs).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("id", "n", "sketch", "tokens"))).alias("m"))

    def whole(t, i):
        return F.shiftleft(i.cast("long"), 32).bitwiseOR(t.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))

    each = F.transform("m", lambda v: v["tokens"] if exact else F.transform(v["tokens"], whole))
    return x.select(
        F.col("m")[0]["id"].alias("g"), F.transform("m", lambda v: v["id"]).alias("ids"), F.transform("m", lambda v: v["n"]).alias("ns"),
        F.transform("m", lambda v: v["sketch"]).alias("sketches"), F.array_distinct(F.flatten(each)).alias("tokens"),
    )


def qualifying(matrix: DataFrame, least: int = LEAST) -> DataFrame:
    """(g, h, overlap), g < h: pairs of groups whose unions share at least so many tokens."""
    a, b = (matrix.select(F.col("g").alias(x), F.explode("tokens").alias("token")) for x in "gh")
    met = a.join(b, "token").filter("g < h").groupBy("g", "h").agg(F.count("*").alias("overlap"))
    return met.filter(F.col("overlap") >= least)


def _opened(exact: bool):
    """Pairs of members of two groups (or of one, where the second is null) within the bounds."""

    def run(batches):
        for b in batches:
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for ids, ns, sk, jds, ms, tk in zip(*(b.column(i).to_pylist() for i in range(6))):
                same = jds is None
                if same:
                    jds, ms, tk = ids, ns, sk
                x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, KEPT) for v in (sk, tk))
                i, n, j, m = (np.array(v, dtype=np.int64) for v in (ids, ns, jds, ms))
                keep = np.minimum(n[:, None], m[None, :]) >= THRESHOLD * np.maximum(n[:, None], m[None, :])
                if not exact:
                    # the query's bound: places at which its minimum hash is one of the group's union
                    union = np.zeros((KEPT, 256), dtype=bool)
                    union[np.arange(KEPT)[None, :], y] = True
                    opens = union[np.arange(KEPT)[None, :], x].sum(1) >= SCREEN
                    keep &= opens[:, None]
                    q = np.flatnonzero(opens)
                    keep[q] &= (x[q][:, None, :] == y[None, :, :]).sum(2) >= SCREEN
                if same:
                    keep &= i[:, None] < j[None, :]
                r, c = np.nonzero(keep)
                out_a.append(np.minimum(i[r], j[c]))
                out_b.append(np.maximum(i[r], j[c]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return run


def _decided(batches):
    for b in batches:
        known: dict[int, np.ndarray] = {}
        rows = []
        for ia, ib, ta, xa, tb, xb in zip(*(b.column(i).to_pylist() for i in range(6))):
            for i, t, x in ((ia, ta, xa), (ib, tb, xb)):
                if i not in known:
                    known[i] = substrings(normal(t, x))
            j = similarity(known[ia], known[ib])
            if j >= THRESHOLD:
                rows.append((ia, ib, j))
        cols = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["rep_a", "rep_b", "similarity"])


def near_duplicates(tales: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives: rep_a < rep_b, similarity; members: id, rep, copies)."""
    rows = tales.filter("text is not null").select(F.col("record_id").alias("id"), "title", "text")
    sketched = cut(rows.mapInArrow(_sketches(exact), _SKETCH.format("bigint" if exact else "int")))
    # equal texts have equal sketches: the row of the least id stands for them
    reps = sketched.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = cut(sketched.select("id", "key").join(reps, "key").select("id", "rep", "copies").distinct())
    # every other row stands for itself, so that mostly nothing is left out
    docs = sketched.join(small_side(members.filter("id <> rep").select("id").distinct()), "id", "left_anti").drop("key")
    # all that is read of the matrix comes from one exchange, which Spark writes once
    matrix = group_matrix(docs, exact)
    side = matrix.select("g", "ids", "ns", "sketches")
    other = side.select(F.col("g").alias("h"), F.col("ids").alias("jds"), F.col("ns").alias("ms"), F.col("sketches").alias("tketches"))
    met = qualifying(matrix, 1 if exact else LEAST).join(side, "g").join(other, "h").select("ids", "ns", "sketches", "jds", "ms", "tketches")
    alone = side.filter("size(ids) > 1").select("ids", "ns", "sketches", *[F.lit(None).cast(t).alias(c) for c, t in (("jds", "array<long>"), ("ms", "array<int>"), ("tketches", "array<binary>"))])
    left = cut(met.unionByName(alone).mapInArrow(_opened(exact), "a long, b long").filter("a <> b"))
    ids = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    texts = rows.join(small_side(ids), "id", "left_semi").dropDuplicates(["id"])
    ta, tb = (texts.select(F.col("id").alias(c), F.col("title").alias(f"t{c}"), F.col("text").alias(f"x{c}")) for c in "ab")
    both = left.join(ta, "a").join(tb, "b").select("a", "b", "ta", "xa", "tb", "xb")
    return both.mapInArrow(_decided, "rep_a long, rep_b long, similarity double"), members


def all_pairs(tales: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b): every pair of rows, copies expanded."""
    pairs, members = near_duplicates(tales)
    a, b = (members.select(F.col("rep").alias(f"rep_{c}"), F.col("id").alias(f"id_{c}")) for c in "ab")
    links = pairs.join(a, "rep_a").join(b, "rep_b").select("id_a", "id_b")
    more = members.filter("copies > 1")
    c, e = (more.select(F.col("rep"), F.col("id").alias(f"id_{x}")) for x in "ab")
    equal = c.join(e, "rep").filter("id_a < id_b").select("id_a", "id_b")
    return links.unionByName(equal).select(F.least("id_a", "id_b").alias("record_id_a"), F.greatest("id_a", "id_b").alias("record_id_b"))


def groups(tales: DataFrame) -> DataFrame:
    """(record_id, group_id, n_links): the component of each row over the links of
    representatives, named by its least id, and its number of links to other texts."""
    pairs, members = near_duplicates(tales)
    pairs = cut(pairs.select("rep_a", "rep_b"))
    labels = components(pairs.select(F.col("rep_a").alias("src"), F.col("rep_b").alias("dst")))
    degree = pairs.select(F.col("rep_a").alias("rep")).unionAll(pairs.select("rep_b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left")
    return named.select(F.col("id").alias("record_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
