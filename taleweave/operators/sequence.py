"""Window functions in two levels, for keys that may hold a large part of all rows.

A bucket that grows with the order (a day of a timestamp, a range of ids) splits each
key; neighbours, numbers and running sums are taken inside (key, bucket), and one row
for each bucket carries them over its borders. So no task sees a whole hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, key: str, order: list[str], bucket: Column, columns: list[str]) -> DataFrame:
    """Adds prev and next (structs of the columns of the row before and after, null at
    the ends) and nth (from 1). The order must be total within a key; a null key is a
    key of its own."""
    row, place = F.struct(*columns), F.struct(*order)
    x = df.withColumn("_b", bucket)
    w = Window.partitionBy(key, "_b").orderBy(*order)
    inner = x.withColumn("_p", F.lag(row).over(w)).withColumn("_f", F.lead(row).over(w)).withColumn("_n", F.row_number().over(w))
    ends = x.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_c")).agg(F.min_by(row, place).alias("_first"), F.max_by(row, place).alias("_last"), F.count("*").alias("_m"))
    over = Window.partitionBy("_k").orderBy("_c")
    carried = ends.select("_k", "_c", F.lag("_last").over(over).alias("_before"), F.lead("_first").over(over).alias("_after"), (F.sum("_m").over(over) - F.col("_m")).alias("_offset"))
    both = inner.join(carried, inner[key].eqNullSafe(carried["_k"]) & inner["_b"].eqNullSafe(carried["_c"]))
    out = both.withColumn("prev", F.coalesce("_p", "_before")).withColumn("next", F.coalesce("_f", "_after")).withColumn("nth", F.col("_n") + F.col("_offset"))
    return out.drop("_b", "_p", "_f", "_n", "_k", "_c", "_before", "_after", "_offset")


def running_sum(df: DataFrame, key: str, order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """Adds the sum of value up to and with each row in the order of its key."""
    x = df.withColumn("_b", bucket).withColumn("_v", value)
    inner = x.withColumn("_s", F.sum("_v").over(Window.partitionBy(key, "_b").orderBy(*order)))
    sums = x.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_c")).agg(F.sum("_v").alias("_t"))
    carried = sums.select("_k", "_c", (F.sum("_t").over(Window.partitionBy("_k").orderBy("_c")) - F.col("_t")).alias("_offset"))
    both = inner.join(carried, inner[key].eqNullSafe(carried["_k"]) & inner["_b"].eqNullSafe(carried["_c"]))
    return both.withColumn(name, F.col("_s") + F.col("_offset")).drop("_b", "_v", "_s", "_k", "_c", "_offset")
