"""Incremental maintenance: manifests, upserts, deletes, versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.operators.sequence import neighbours


def manifest(df: DataFrame, path: str, content: str) -> DataFrame:
    """(path, sha256, size): fingerprints of contents; null contents count as empty."""
    c = F.coalesce(F.col(content), F.lit(""))
    return df.select(F.col(path).alias("path"), F.sha2(c, 256).alias("sha256"), F.octet_length(c).cast("long").alias("size"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): added, removed, updated or unchanged, by content hash."""
    o, n = old.select("path", F.col("sha256").alias("o")), new.select("path", F.col("sha256").alias("n"))
    x = o.join(n, "path", "full_outer")
    return x.select("path", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "updated").otherwise("unchanged").alias("status"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows replace those of the same keys. Rows must be unique by key (see latest)."""
    return target.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(target: DataFrame, predicate: Column) -> DataFrame:
    """Without the rows that the predicate is true for; null keeps."""
    return target.filter(~F.coalesce(predicate, F.lit(False)))


def matches(conditions: dict) -> Column:
    """All of: column equals the value, or is in the list; None matches absence."""

    def one(c: str, v) -> Column:
        if isinstance(v, (list, tuple, set)):
            some = [x for x in v if x is not None]
            out = F.col(c).isin(*some) if some else F.lit(False)
            return F.coalesce(out, F.lit(False)) | (F.col(c).isNull() if None in v else F.lit(False))
        return F.col(c).eqNullSafe(F.lit(v))

    return reduce(lambda a, b: a & b, (one(c, v) for c, v in conditions.items()), F.lit(True))


def versions(df: DataFrame, key: str, at: str, tie: str, bucket: Column | None = None) -> DataFrame:
    """Slowly changing dimension: version, valid_from, valid_to, is_current per key in the
    order of at and tie. Buckets of time (months of at by default) split hot keys."""
    b = F.date_trunc("month", at) if bucket is None else bucket
    x = neighbours(df, key, [at, tie], b, [at])
    return x.select(*df.columns, F.col("nth").alias("version"), F.col(at).alias("valid_from"), F.col(f"next.{at}").alias("valid_to"), F.col("next").isNull().alias("is_current"))


def pending(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Prompts without a recorded answer, by hash."""
    return prompts.withColumn("prompt_sha256", F.sha2("prompt", 256)).join(answers.select("prompt_sha256"), "prompt_sha256", "left_anti")


def replayed(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Prompts with their recorded answer (prompt_sha256, answer), null where missing."""
    return prompts.withColumn("prompt_sha256", F.sha2("prompt", 256)).join(answers.select("prompt_sha256", "answer"), "prompt_sha256", "left")
