"""Readings of model replies that are no plain JSON, and identifiers."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Namespace of name-based point ids.
NAMESPACE = uuid.NAMESPACE_URL


def grounding(reply: Column) -> Column:
    """struct(grounded, score, supported, unsupported) of a reply in lines GROUNDED: yes|no,
    SCORE: number, SUPPORTED: a; b, UNSUPPORTED: a; b. A missing line gives null or an
    empty list; the score is kept within 0 and 1."""

    def line(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(reply, rf"(?im)^\s*{name}\s*:\s*(.*)$", 1)), F.lit(""))

    def items(name: str) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(line(name), F.lit("")), ";"), lambda v: F.trim(v)), lambda v: v != "")

    score = F.try_to_number(F.regexp_extract(line("SCORE"), r"\d+(?:\.\d+)?", 0), F.lit("999999.999999")).cast("double")
    return F.struct(line("GROUNDED").rlike("(?i)^(yes|true|có|đúng)").alias("grounded"), F.when(score.isNotNull(), F.least(score, F.lit(1.0))).alias("score"), items("SUPPORTED").alias("supported"), items("UNSUPPORTED").alias("unsupported"))


def routed_by(reply: Column, levels: tuple[str, ...] = ("simple", "medium", "complex"), default: str = "medium") -> Column:
    """The first level named in the first line of a reply, default if none is."""
    first = F.lower(F.get(F.split(F.coalesce(reply, F.lit("")), r"\n"), 0))
    out = F.lit(default)
    for level in reversed(levels):
        out = F.when(first.contains(level), level).otherwise(out)
    return out


def affirmed(reply: Column) -> Column:
    """yes, có or đúng at the start of a reply; no reply counts as yes."""
    return F.coalesce(F.lower(F.trim(reply)).rlike("^(yes|có|đúng)"), F.lit(True))


def scope(k: Column, conditions: Column, rerank: Column) -> Column:
    """Canonical text of a search setting, for cache keys: the map in the order of keys."""
    entries = F.array_sort(F.map_entries(F.coalesce(conditions, F.create_map().cast("map<string,string>"))))
    return F.to_json(F.struct(entries.alias("filter"), k.alias("k"), rerank.alias("rerank")))


@F.pandas_udf(StringType())
def _point(ids: pd.Series) -> pd.Series:
    def one(x: str) -> str:
        if x.isdigit():
            return x
        try:
            return str(uuid.UUID(x))
        except ValueError:
            return str(uuid.uuid5(NAMESPACE, x))

    return ids.map(one, na_action="ignore")


def point_id(c: Column) -> Column:
    """Unsigned numbers and UUIDs as they are, other ids as name-based UUIDs."""
    return _point(c.cast("string"))


# Words before a person and before a place.
_TITLES = r"(?:ông|bà|anh|chị|cô|chú|bác|vua|hoàng tử|công chúa|Mr\.?|Mrs\.?|Dr\.?|King|Queen)"
_PLACES = r"(?:làng|núi|sông|hồ|chùa|thành|xã|rừng|bến|village|river|mount|lake|forest)"
_NAME = r"\p{Lu}[\w'’]*(?:\s\p{Lu}[\w'’]*){0,3}"
_PATTERNS = (("LOCATION", re.compile(rf"\b{_PLACES}\s+({_NAME})")), ("PERSON", re.compile(rf"\b{_TITLES}\s+({_NAME})")), ("NAME", re.compile(rf"(?<![.!?]\s)(?<!^)\b(\p{{Lu}}[\w'’]+(?:\s\p{{Lu}}[\w'’]+){{1,3}})")))


def pattern_entities(text: str) -> list[tuple[str, str, int, int]]:
    """Entities by patterns, in the order of position; the first pattern that takes a place
    keeps it. Positions count from 0, the end is exclusive."""
    out: list[tuple[str, str, int, int]] = []
    for kind, p in _PATTERNS:
        for m in p.finditer(text):
            s, e = m.span(1)
            if not any(s < b and e > a for _, _, a, b in out):
                out.append((m.group(1), kind, s, e))
    return sorted(out, key=lambda x: x[2])


def _found(batches):
    for b in batches:
        rows = [(k, *e) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for e in pattern_entities(t)]
        cols = list(zip(*rows)) or [[] for _ in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32()))], ["key", "text", "type", "start", "end"])


def entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, type, start, end) of pattern_entities of every text, a batch at a time."""
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_found, f"key {rows.schema['key'].dataType.simpleString()}, text string, type string, start int, end int")
