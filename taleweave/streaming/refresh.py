"""Structured Streaming: continuous refresh of a folder, limits and usage on events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def folder_stream(spark: SparkSession, root: str, schema: str = "path string, modificationTime timestamp, length long, content binary", pattern: str = "*.md") -> DataFrame:
    """New and changed files of a folder tree with their hash."""
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return raw.select("path", "modificationTime", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def refreshed(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs apply(batch, id) once per batch. Ids make it idempotent, so that a batch
    repeated after a failure changes nothing."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_stream(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Requests, mean value and approximate users per window and type; rows later than
    the watermark are dropped."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"), F.approx_count_distinct("user_id").alias("users"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "avg_value", "users")
    )


def limiter(window_s: float, limit: int) -> Callable:
    """A stateful sliding-window limiter per key for applyInPandasWithState: state is the
    times admitted within the window."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        for f in frames:
            f = f.sort_values(["s", "id"])
            out = []
            for s in f["s"]:
                held = [h for h in held if h > s - window_s]
                ok = len(held) < limit
                if ok:
                    held.append(float(s))
                out.append(ok)
            yield pd.DataFrame({"key": key[0], "id": f["id"].to_numpy(), "admitted": out})
        state.update((held,))
        state.setTimeoutDuration(int(window_s * 1000) + 1)

    return run


def limited_stream(events: DataFrame, window_s: float, limit: int) -> DataFrame:
    """(key, id, admitted) of a stream (key, id, s)."""
    return events.groupBy("key").applyInPandasWithState(limiter(window_s, limit), "key long, id long, admitted boolean", "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
