"""Problem 1: splitting oversized texts at natural boundaries.

Only texts longer than the limit of their configuration leave the JVM. In the
Arrow function each text becomes a token offset prefix sum (the code point
position after every word) and sorted arrays of paragraph, sentence and clause
ends; a piece ends at the last boundary under the limit, found by binary search,
and the next one starts chunk_overlap code points before that end. Where no
boundary lies under the limit the cut is hard, but never before a combining mark.

Defined results: a null text, an empty text and a text not longer than its limit
give no pieces; a record whose config_id is null or unknown takes the default
row; an overlap of the limit or more is lowered to limit - 1; repeated rows are
split each for itself; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.session import small_side

_WORD = re.compile(r"\S+\s*|^\s+")
_PARAGRAPH = re.compile(r"\n[ \t]*\r?\n\s*")
_SENTENCE = re.compile(r"(?:(?<![.!?…])[.!?…]+[\"”»’)\]]*\s+(?=[^\sa-zа-яà-ÿ])|[。！？।]+[」』”’）]*\s*)")
_SHORT = re.compile(r"(?:^|[\s(])\w{1,3}\.\s+$")
_CLAUSE = re.compile(r"(?:[,;:–—]\s+|[，、；：]|\n)")


def boundaries(text: str) -> tuple[list[int], list[int], list[int], list[int]]:
    """Sorted ends of paragraphs, sentences, clauses and words (prefix sums)."""
    para = [m.end() for m in _PARAGRAPH.finditer(text)]
    sent = [m.end() for m in _SENTENCE.finditer(text) if not (text[m.start()] == "." and _SHORT.search(text[max(0, m.start() - 4) : m.end()]))]
    return para, sent, [m.end() for m in _CLAUSE.finditer(text)], list(accumulate(len(w) for w in _WORD.findall(text)))


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut) of each piece, 0-based, end exclusive."""
    n, limit = len(text), max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    if n <= limit:
        return [(0, n, "end")]
    para, sent, clause, word = boundaries(text)
    half = limit // 2
    order = ((para, half, "paragraph"), (sent, 0, "sentence"), (para, 0, "paragraph"), (clause, 0, "clause"), (word, 0, "word"))
    out, start = [], 0
    while n - start > limit:
        end, kind = 0, ""
        for ends, least, kind in order:
            i = bisect_right(ends, start + limit)
            if i and ends[i - 1] > start + max(overlap, least):
                end = ends[i - 1]
                break
        else:
            end, kind = start + limit, "hard"
            while end > start + overlap + 1 and (unicodedata.combining(text[end]) or text[end] in "‍️"):
                end -= 1
        out.append((start, end, kind))
        start = end - overlap
    out.append((start, n, "end"))
    return out


_OUT = "src string, row_id long, piece_no int, start_pos int, end_pos int, n_chars int, cut string"


def _split(with_text: bool):
    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(8 if with_text else 7)]
            for src, row, text, limit, overlap in zip(*(b.column(i).to_pylist() for i in range(5))):
                for k, (s, e, kind) in enumerate(pieces(text, limit, overlap)):
                    for c, v in zip(cols, (src, row, k, s + 1, e, e - s, kind, text[s:e] if with_text else None)):
                        c.append(v)
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            names = ["src", "row_id", "piece_no", "start_pos", "end_pos", "n_chars", "cut", "piece_text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names[: len(cols)])

    return run


def with_limits(df: DataFrame, src: str, id_col: str, configs: DataFrame) -> DataFrame:
    """(src, row_id, text, max_chunk_size, chunk_overlap); the default configuration
    is the row with is_default (the one of the lowest config_id if there are several)."""
    c = configs.groupBy("config_id").agg(F.min("max_chunk_size").alias("max_chunk_size"), F.min("chunk_overlap").alias("chunk_overlap"), F.max("is_default").alias("is_default"))
    default = c.filter("is_default").orderBy("config_id").first() or c.orderBy("config_id").first()
    t = df.select(F.lit(src).alias("src"), F.col(id_col).cast("long").alias("row_id"), "text", F.col("config_id").alias("cfg")).filter("text is not null")
    if default is None:
        return t.select("src", "row_id", "text", F.lit(None).cast("int").alias("limit"), F.lit(None).cast("int").alias("overlap"))
    return t.join(small_side(c), t.cfg == c.config_id, "left").select(
        "src", "row_id", "text", F.coalesce("max_chunk_size", F.lit(default.max_chunk_size)).alias("limit"), F.coalesce("chunk_overlap", F.lit(default.chunk_overlap), F.lit(0)).alias("overlap")
    )


def split_oversized(rows: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of the oversized texts of rows (src, row_id, text, limit, overlap).
    The length filter runs in the scan; there is no shuffle."""
    big = rows.filter(F.length("text") > F.col("limit"))
    return big.mapInArrow(_split(with_text), _OUT + (", piece_text string" if with_text else ""))
