"""Generators of chunks (one text to many).

The sequential ones run in Arrow functions, text by text, without a shuffle; the
others are SQL. Null and empty texts give no chunks. Positions count from 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.operators.sequence import neighbours, running_sum

# Separators from the coarsest to the finest.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def recursive_pieces(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, str]]:
    """(start, piece): the coarsest separators are tried first, parts that are still
    too long are split by the next ones, and neighbours are merged up to size, each
    piece beginning with whole parts of the last overlap characters."""

    def parts(s: int, e: int, level: int) -> list[tuple[int, int]]:
        if e - s <= size:
            return [(s, e)]
        while level < len(separators) - 1 and separators[level] not in text[s:e]:
            level += 1
        sep = separators[level]
        if not sep:
            return [(i, min(i + size, e)) for i in range(s, e, size)]
        out, at = [], s
        while at < e:
            cut = text.find(sep, at, e)
            end = e if cut < 0 else cut + len(sep)
            out += parts(at, end, level + 1) if end - at > size else [(at, end)]
            at = end
        return out

    out: list[tuple[int, str]] = []
    held: list[tuple[int, int]] = []
    for s, e in parts(0, len(text), 0):
        if held and e - held[0][0] > size:
            out.append((held[0][0], text[held[0][0] : held[-1][1]]))
            while held and (held[-1][1] - held[0][0] > overlap or e - held[0][0] > size):
                held.pop(0)
        held.append((s, e))
    if held:
        out.append((held[0][0], text[held[0][0] : held[-1][1]]))
    trimmed = [(s + len(p) - len(p.lstrip()), p.strip()) for s, p in out]
    return [(s, p) for s, p in trimmed if p]


def boundary_windows(text: str, size: int = 1000, overlap: int = 200, look_back: int = 100) -> list[tuple[int, str]]:
    """Windows of size that end after a terminator or line break within the last
    look_back characters; the next starts overlap before the end, always forward."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            for i in range(end - 1, max(start, end - look_back) - 1, -1):
                if text[i] in ".!?\n":
                    end = i + 1
                    break
        piece = text[start:end].strip()
        if piece:
            out.append((start, piece))
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    return out


def paragraph_units(text: str, size: int = 4000) -> list[tuple[int, str]]:
    """Paragraphs packed up to size; longer ones are cut hard."""
    out, held, start, at = [], "", 0, 0
    for p in re.split(r"\n\s*\n", text):
        where = text.index(p, at) if p else at
        at = where + len(p)
        p = p.strip()
        if not p:
            continue
        if held and len(held) + 2 + len(p) > size:
            out.append((start, held))
            held = ""
        while len(p) > size:
            out.append((where, p[:size]))
            p, where = p[size:], where + size
        held, start = (held + "\n\n" + p, start) if held else (p, where)
    if held:
        out.append((start, held))
    return out


def sentence_packs(text: str, size: int = 500, overlap: int = 50) -> list[tuple[int, str]]:
    """Sentences packed greedily; the last sentences within overlap are repeated."""
    out: list[tuple[int, str]] = []
    held: list[tuple[int, str]] = []
    for m in re.finditer(r"\S.*?(?:[.!?](?=\s|$)|$)", text, re.S):
        s = (m.start(), m.group())
        if held and sum(len(x) for _, x in held) + len(s[1]) > size:
            out.append((held[0][0], " ".join(x for _, x in held)))
            kept: list[tuple[int, str]] = []
            for x in reversed(held):
                if sum(len(y) for _, y in kept) + len(x[1]) > overlap:
                    break
                kept.insert(0, x)
            held = kept
        held.append(s)
    if held:
        out.append((held[0][0], " ".join(x for _, x in held)))
    return out


STRATEGIES: dict[str, Callable] = {"recursive": recursive_pieces, "windows": boundary_windows, "paragraphs": paragraph_units, "sentences": sentence_packs}


def _chunked(split: Callable):
    def run(batches):
        for b in batches:
            keys, no, starts, texts = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, (s, p) in enumerate(split(text)):
                    keys.append(key)
                    no.append(i)
                    starts.append(s)
                    texts.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(no, pa.int32()), pa.array(starts, pa.int32()), pa.array(texts, pa.string())], ["key", "chunk_index", "start_index", "chunk"])

    return run


def chunk(df: DataFrame, key: str, text: str = "text", strategy: str | Callable = "recursive", **options) -> DataFrame:
    """(key, chunk_index, start_index, chunk) by a named strategy or a function from a
    text to (start, piece) pairs. An unknown name raises ValueError."""
    f = STRATEGIES.get(strategy) if isinstance(strategy, str) else strategy
    if f is None:
        raise ValueError(f"unknown strategy: {strategy}")
    split = (lambda t: f(t, **options)) if options else f
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_chunked(split), f"key {rows.schema['key'].dataType.simpleString()}, chunk_index int, start_index int, chunk string")


#: Windows that are cut from one part of the text.
BLOCK = 64


def fixed_windows(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """Windows of equal size in SQL: (key, chunk_index, start_index, chunk). The text is cut
    to parts of BLOCK windows first, so that a window is near the beginning of its part
    and the whole text does not travel with each window."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(step)), F.lit(1)).cast("long") - 1
    rows = df.filter(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"), last.alias("last"))
    parts = rows.select("key", "last", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / BLOCK))).alias("part"))
    parts = parts.select("key", "last", "part", F.expr(f"substring(text, cast(part * {BLOCK * step} + 1 as int), {BLOCK * step + overlap})").alias("text"))
    each = parts.select("key", "part", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(BLOCK - 1).cast("long"), F.col("last") - F.col("part") * BLOCK))).alias("i"))
    at = F.col("part") * BLOCK + F.col("i")
    return each.select("key", at.cast("int").alias("chunk_index"), (at * step).cast("int").alias("start_index"), F.expr(f"substring(text, cast(i * {step} + 1 as int), {size})").alias("chunk"))


def token_windows(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """Windows of white-space tokens: (key, chunk_index, chunk)."""
    step = size - overlap
    rows = df.withColumn("_t", F.filter(F.split(text, r"[ \t\r\n]+"), lambda x: x != "")).filter(F.size("_t") > 0)
    n = F.greatest(F.ceil((F.size("_t") - overlap) / F.lit(step)), F.lit(1))
    return rows.select(F.col(key).alias("key"), "_t", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("i")).select(
        "key", F.col("i").cast("int").alias("chunk_index"), F.array_join(F.expr(f"slice(_t, cast(i * {step} + 1 as int), {size})"), " ").alias("chunk")
    )


def stable_ids(chunks: DataFrame, source: str, order: list[str | Column], text: str) -> DataFrame:
    """Adds document_id, chunk_index, chunk_sha256 and chunk_id; the index runs within
    the source in the given total order."""
    w = Window.partitionBy(source).orderBy(*order)
    x = chunks.withColumn("chunk_index", F.row_number().over(w) - 1).withColumn("document_id", F.sha2(F.col(source).cast("string"), 256)).withColumn("chunk_sha256", F.sha2(text, 256))
    return x.withColumn("chunk_id", F.sha2(F.concat_ws(":", "document_id", F.col("chunk_index").cast("string"), "chunk_sha256"), 256))


def parent_child(df: DataFrame, key: str, text: str = "text", parent: int = 500, child: int = 250, overlap: int = 25) -> tuple[DataFrame, DataFrame]:
    """(parents: parent_id, key, text; children: parent_id, child_index, text). The
    parent text is kept once and joined by parent_id, not copied into its children."""
    p = chunk(df, key, text, "recursive", size=parent, overlap=overlap)
    parents = p.select(F.substring(F.sha1(F.concat_ws("\n", F.col("key").cast("string"), F.col("start_index").cast("string"), "chunk")), 1, 20).alias("parent_id"), "key", F.col("chunk").alias("text"))
    c = chunk(parents, "parent_id", "text", "recursive", size=child, overlap=overlap)
    return parents, c.select(F.col("key").alias("parent_id"), F.col("chunk_index").alias("child_index"), F.col("chunk").alias("text"))


def breakpoints(vectors: DataFrame, group: str, order: str, bucket: Column, vector: str, similarity: Callable, threshold: float) -> DataFrame:
    """Adds similarity to the row before and the running chunk number: a chunk begins
    where the similarity is under the threshold. bucket, growing with the order, splits
    a long group over tasks."""
    x = neighbours(vectors, group, [order], bucket, [vector]).withColumn("similarity", similarity(F.col(f"prev.{vector}"), F.col(vector)))
    return running_sum(x.drop("prev", "next", "nth"), group, [order], bucket, F.when(F.col("similarity") < threshold, 1).otherwise(0), "chunk_no")


def sequential_groups(chunks: DataFrame, group: str, index: str, size: int = 5) -> DataFrame:
    """Adds group_no: runs of size neighbours; a rest smaller than half joins the last run."""
    counts = chunks.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    x = chunks.join(counts, F.col(group).eqNullSafe(F.col("_g")))
    n = F.col("_n")
    full = F.greatest(F.floor(n / size), F.lit(1))
    rest = n - F.floor(n / size) * size
    last = F.when((rest >= -(-size // 2)) | (n < size), F.ceil(n / size) - 1).otherwise(full - 1)
    return x.withColumn("group_no", F.least(F.floor(F.col(index) / size), last).cast("int")).drop("_g", "_n")


def routed(text: Column) -> Column:
    """The strategy an adaptive chunker takes: short texts semantic, texts of many
    blank lines contextual, else default."""
    return F.when(F.length(text) < 500, "semantic").when(F.regexp_count(text, F.lit(r"\n\s*\n")) > 5, "contextual").otherwise("default")
