"""Sinks: table upserts by key, exports and placement by category."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.operators.incremental import upsert


def write_versioned(df: DataFrame, root: str) -> str:
    """Writes a new version of a table beside the old ones and returns its path; readers
    of an older version are not disturbed. The pointer file is written last."""
    path = f"{root}/v={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    spark = df.sparkSession
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").json(f"{root}/_current")
    return path


def read_current(spark: SparkSession, root: str) -> DataFrame:
    path = spark.read.schema("path string").json(f"{root}/_current").first().path
    return spark.read.parquet(path)


def upsert_table(spark: SparkSession, root: str, rows: DataFrame, keys: list[str]) -> str:
    """Rows replace those of the same keys in the current version of a table."""
    return write_versioned(upsert(read_current(spark, root), rows, keys), root)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines; letters outside ASCII are kept."""
    df.write.mode("overwrite").json(path)


def place_by_category(df: DataFrame, root: str, category: str = "category") -> None:
    df.write.mode("overwrite").partitionBy(category).parquet(root)


def graph_export(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_key, graph): entities and relations of each document as JSON."""
    e = entities.groupBy("document_key").agg(F.sort_array(F.collect_set(F.struct("name", "type"))).alias("entities"))
    r = relations.groupBy("document_key").agg(F.sort_array(F.collect_set(F.struct("source", "target"))).alias("relationships"))
    return e.join(r, "document_key", "full_outer").select("document_key", F.to_json(F.struct("entities", "relationships")).alias("graph"))
