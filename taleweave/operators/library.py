"""Record tables: lists, searches, tags, keys and permissions, story filters, relations.

Records have typed columns and array<string> tags; a null column counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tags(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def listed(records: DataFrame, status: str = "active", category: str | None = None, tags: list[str] | None = None, columns: tuple[str, str, str] = ("status", "category", "tags")) -> DataFrame:
    """Records of a status, of a category if one is asked for, with any of the tags."""
    s, c, t = columns
    out = records.filter(F.col(s) == status)
    if category:
        out = out.filter(F.col(c) == category)
    if tags:
        out = out.filter(F.arrays_overlap(_tags(t), F.array(*[F.lit(x) for x in tags])))
    return out


def contains_in(fields: list[Column], wanted: Column) -> Column:
    """Whether one of the fields holds the text, without regard to case; null fields do not."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(f).contains(F.lower(wanted)), F.lit(False)) for f in fields))


def searched(records: DataFrame, wanted: str, fields: list[str], tags: str | None = None) -> DataFrame:
    """Records one of whose fields holds the text; tags are joined by spaces."""
    columns = [F.col(f) for f in fields] + ([F.array_join(_tags(tags), " ")] if tags else [])
    return records.filter(contains_in(columns, F.lit(wanted)))


def in_library(records: DataFrame, wanted: str, fields: list[str], tags: str) -> DataFrame:
    """Records one of whose fields or a single tag holds the text."""
    q = F.lower(F.lit(wanted))
    return records.filter(contains_in([F.col(f) for f in fields], F.lit(wanted)) | F.exists(_tags(tags), lambda t: F.coalesce(F.lower(t).contains(q), F.lit(False))))


def tagged(tags: Column, new: list[str]) -> Column:
    """Tags with the new ones, each once, in order."""
    return F.array_sort(F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in new])))


def untagged(tags: Column, gone: list[str]) -> Column:
    return F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~F.coalesce(t.isin(*gone), F.lit(False)))


def valid_keys(keys: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Keys (api_key, user_id, is_active, expires_at, permissions) that are active and not
    expired, of active users (user_id, is_active). A key without expiry never expires."""
    live = keys.filter(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") >= now)))
    return live.join(users.filter("is_active").select("user_id").distinct(), "user_id", "left_semi")


def permitted(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """asked (api_key, permission) with allowed: the key is active and has the permission."""
    known = keys.filter("is_active").select("api_key", "permissions").dropDuplicates(["api_key"])
    return asked.join(known, "api_key", "left").withColumn("allowed", F.coalesce(F.array_contains("permissions", F.col("permission")), F.lit(False))).drop("permissions")


def mutual(relations: DataFrame, reverse: dict[str, str]) -> DataFrame:
    """(a, b, kind) with the reverse of every relation, of the kind the map names (else the
    same), once each."""
    back = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in reverse.items() for x in kv]), F.col("kind")), F.col("kind")) if reverse else F.col("kind")
    return relations.select("a", "b", "kind").unionByName(relations.select(F.col("b").alias("a"), F.col("a").alias("b"), back.alias("kind"))).distinct()


def document_texts(pages: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """(key, text, sha256, n_pages): the pages of each document that are not blank, in
    order, joined by a blank line. A document's pages meet in one row."""
    kept = pages.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    g = kept.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["_t"]), "\n\n")
    return g.select("key", joined.alias("text"), F.sha2(joined, 256).alias("sha256"), F.size("p").cast("long").alias("n_pages"))
