"""Caches, limits, usage analytics and conversation memory over event tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions import text as T
from taleweave.functions import vectors as V
from taleweave.operators.sequence import neighbours, running_sum
from taleweave.session import small_side


def seconds(c: str | Column) -> Column:
    """Seconds since the epoch of a timestamp with or without zone (UTC session)."""
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp")) / 1e6


def window_counts(events: DataFrame, key: str, ts: str, window_s: int, tie: str) -> DataFrame:
    """Adds in_window: events of the key in the window_s seconds up to the event, the
    lower bound excluded; simultaneous events all count. A key is split into buckets of
    16 windows; every event also stands in the next bucket, where it is only counted."""
    us, size = F.unix_micros(F.col(ts).cast("timestamp")), window_s * 1_000_000
    own = F.floor(F.col("_us") / (16 * size))
    near = F.floor((F.col("_us") + size - 1) / (16 * size))
    x = events.withColumn("_us", us).withColumn("_b", F.explode(F.array_distinct(F.array(own, near)))).withColumn("_own", F.col("_b") == own)
    w = Window.partitionBy(key, "_b").orderBy("_us").rangeBetween(-(size - 1), 0)
    return x.withColumn("in_window", F.count("*").over(w)).filter("_own").drop("_us", "_b", "_own")


def admitted(events: DataFrame, key: str, ts: str, tie: str, window_s: float, limit: int) -> DataFrame:
    """(key, id, admitted): sliding-window limiter that counts admitted requests only.
    A pause of a whole window empties it, so the stretches between such pauses are
    decided apart; inside a stretch events stream in order and only the admitted times
    of one window are held. Events without key or time are left out."""
    x = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(tie).cast("long").alias("id"), seconds(ts).alias("s"))
    day = F.floor(F.col("s") / F.lit(max(float(window_s), 1.0) * 16))
    gaps = neighbours(x, "key", ["s", "id"], day, ["s"]).select("key", "id", "s", F.when(F.col("s") - F.col("prev.s") >= window_s, 1).otherwise(0).alias("gap"))
    cut_ = running_sum(gaps, "key", ["s", "id"], day, F.col("gap"), "stretch").select("key", "stretch", "s", "id")

    def run(batches):
        now, held = None, []
        for b in batches:
            keys, stretches, times = (b.column(i).to_pylist() for i in range(3))
            out = []
            for k, g, s in zip(keys, stretches, times):
                if (k, g) != now:
                    now, held = (k, g), []
                held = [h for h in held if h > s - window_s]
                ok = len(held) < limit
                if ok:
                    held.append(s)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(out, pa.bool_())], ["key", "id", "admitted"])

    return cut_.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "s", "id").mapInArrow(run, "key long, id long, admitted boolean")


def admitted_by_limits(events: DataFrame, limits: DataFrame, key: str, ts: str, tie: str, default: tuple[int, float] = (100, 60.0)) -> DataFrame:
    """The same with a limit for each key: limits (key, max_requests, window_s); keys that
    are not listed have the default. Keys of one limit are decided together."""
    known = events.join(small_side(limits.select(F.col("key").alias("_k"), "max_requests", "window_s").dropDuplicates(["_k"])), F.col(key) == F.col("_k"), "left")
    rules = limits.select("max_requests", "window_s").distinct().collect()  # as many as there are kinds of limits
    out = admitted(known.filter("_k is null"), key, ts, tie, default[1], default[0])
    for r in rules:
        out = out.unionByName(admitted(known.filter((F.col("max_requests") == r.max_requests) & (F.col("window_s") == r.window_s)), key, ts, tie, float(r.window_s), int(r.max_requests)))
    return out


def remaining(counts: DataFrame, limit: int) -> DataFrame:
    """Adds what a key may still ask for after the requests of its window (in_window)."""
    return counts.withColumn("remaining", F.greatest(F.lit(limit) - F.col("in_window"), F.lit(0)))


def query_key(question: Column, scope: Column) -> Column:
    """The key of an exact answer cache: the normalised question and the setting."""
    return F.sha2(F.concat_ws("|", T.normal(question), scope), 256)


def ttl_hits(accesses: DataFrame, key: str, ts: str, tie: str, ttl_s: int) -> DataFrame:
    """Adds hit: the key was accessed at most ttl_s seconds before."""
    x = neighbours(accesses, key, [ts, tie], F.date_trunc("day", ts), [ts])
    gap = seconds(ts) - seconds(f"prev.{ts}")
    return x.withColumn("hit", F.coalesce(gap <= ttl_s, F.lit(False))).drop("prev", "next", "nth")


def lru_resident(accesses: DataFrame, key: str, ts: str, tie: str, capacity: int) -> DataFrame:
    """(key, last_ts): the keys a cache of the capacity holds after all accesses."""
    last = accesses.groupBy(key).agg(F.max(F.struct(ts, tie)).alias("m")).select(F.col(key).alias("key"), F.col(f"m.{ts}").alias("last_ts"), F.col(f"m.{tie}").alias("last_id"))
    return last.orderBy(F.desc("last_ts"), F.desc("last_id")).limit(capacity)


def semantic_lookup(asked: DataFrame, entries: DataFrame, threshold: float, ttl_s: int) -> DataFrame:
    """(query_id, entry_id, similarity): the best entry of the same scope, put at most
    ttl_s seconds before, at or above the threshold. asked: query_id, scope, at (s),
    vector; entries: entry_id, scope, at, vector."""
    # entries stand in the period they were put in and in the next one, so that times meet by equality
    e = entries.withColumn("_p", F.explode(F.array(F.floor(F.col("at") / ttl_s), F.floor(F.col("at") / ttl_s) + 1)))
    q = asked.withColumn("_p", F.floor(F.col("at") / ttl_s))
    x = q.alias("q").join(e.alias("e"), F.expr("q.scope = e.scope and q._p = e._p and e.at <= q.at and q.at - e.at <= " + str(ttl_s)))
    s = x.select(F.col("q.query_id"), F.col("e.entry_id"), F.round(V.cosine(F.col("q.vector"), F.col("e.vector")), 6).alias("similarity"))
    best = s.filter(F.col("similarity") >= threshold).groupBy("query_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "entry_id")).alias("m"))
    return best.select("query_id", F.col("m.entry_id").alias("entry_id"), (-F.col("m.s")).alias("similarity"))


def usage(events: DataFrame, ts: str, now: str, days: int | None, user: str, value: str) -> DataFrame:
    """Totals of the last days before now (all if None): n, mean and sum of the value,
    distinct users (null ones not counted)."""
    x = events if days is None else events.filter(F.col(ts) > F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))
    return x.agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("avg_value"), F.round(F.sum(value), 4).alias("sum_value"), F.countDistinct(user).alias("users"))


def top_topics(df: DataFrame, text: str, k: int = 5) -> DataFrame:
    """(word, n): the most frequent lower-case words longer than 3, ties by word."""
    w = df.select(F.explode(F.split(F.lower(text), r"[ \t\r\n]+")).alias("word")).filter(F.length("word") > 3)
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def memory_window(turns: DataFrame, conversation: str, order: str, n: int) -> DataFrame:
    """The last n turns of each conversation. Every task keeps only its own last n of a
    conversation before the shuffle, so a hot one is no load."""
    w = Window.partitionBy(conversation).orderBy(F.desc(order))
    return turns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def previous_turns(turns: DataFrame, conversation: str, order: str, text: str, n: int = 3, bucket: Column | None = None, span: int = 1000) -> DataFrame:
    """Adds context: the n texts before each turn, joined by line breaks. Turns are
    numbered over buckets that grow with the order, and runs of span turns carry the
    last n of the run before."""
    x = neighbours(turns, conversation, [order], F.floor(F.col(order) / span) if bucket is None else bucket, [order]).drop("prev", "next")
    at = F.col("nth") - 1
    own = F.floor(at / span)
    x = x.withColumn("_o", own).withColumn("_s", F.explode(F.when(F.pmod(at, F.lit(span)) >= span - n, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(conversation, "_s").orderBy("nth").rowsBetween(-n, -1)
    return x.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n")).filter("_s = _o").drop("_s", "_o", "nth")


def context_string(turns: DataFrame, conversation: str, order: str, role: str, text: str, n: int) -> DataFrame:
    """(conversation, context): the last n turns as lines of speaker and text."""
    line = F.concat(F.when(F.col(role) == "user", "User").otherwise("Assistant"), F.lit(": "), F.coalesce(text, F.lit("")))
    g = memory_window(turns, conversation, order, n).groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("ls"))
    return g.select(conversation, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("context"))
