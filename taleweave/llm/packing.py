"""Problem 8: filling windows of a fixed capacity with whole documents.

Minimum bin slack on the histogram of lengths. The plan of a window size depends on
the counts of the lengths only, of which there are at most as many as its capacity,
so it is made in one small task however many documents there are: the largest
length left opens a bin, a bitset subset-sum dynamic program over the available
lengths finds the fullest combination that fits beside it, and this pattern is taken
as many times as the counts allow and removed. Documents get their rank among those
of their length (salted, so that a frequent length is counted in parts) and find
their bin by the rank ranges of the plan.

Only a text that alone exceeds the capacity is divided, into full pieces and a rest,
which is packed like a document.

Defined results: null texts are left out; texts without tokens need no space and
have no bin (bin_no null); repeated rows are packed each for itself; ties of length
are taken in the order of the hash salt and doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.session import cut

#: Window sizes that are planned at once.
AT_ONCE = 1_000
#: Rows of one length that one task ranks, on average at most.
RANKED = 1_000_000


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of lengths (descending, within counts) of the greatest total that
    is at most room. Bit t of a bitset says that a total of t can be reached."""
    full = (1 << (room + 1)) - 1
    bits, steps = 1, []
    for n in lengths:
        if n > room:
            continue
        left, part = min(counts[n], room // n), 1
        while left > 0:
            k = min(part, left)
            new = bits | ((bits << (n * k)) & full)
            if new != bits:
                steps.append((n, k, bits))
                bits = new
            left -= k
            part *= 2
        if bits >> room:
            break
    total, out = bits.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            out[n] = out.get(n, 0) + k
            total -= n * k
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, items of the length per bin)."""
    counts = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(counts, reverse=True)
    used = dict.fromkeys(lengths, 0)
    out, bin_no = [], 0
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        pattern = fullest(counts, lengths, capacity - seed)
        counts[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        copies = min(counts[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            out.append((n, used[n], used[n] + copies * k, bin_no, k))
            used[n] += copies * k
            counts[n] -= copies * k
        bin_no += copies
        lengths = [n for n in lengths if counts[n]]
    return out


def _planned(group: pd.DataFrame) -> pd.DataFrame:
    w, capacity = int(group["window_id"].iloc[0]), int(group["capacity"].iloc[0])
    rows = plan({int(n): int(c) for n, c in zip(group["size"], group["n_items"])}, capacity)
    return pd.DataFrame([(w, *r) for r in rows], columns=["window_id", "size", "first_rank", "end_rank", "first_bin", "per_bin"])


def pack(counts: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, bin_no, doc_id, piece_no, start_token, n_tokens) of every document
    (doc_id, n_tokens) in each window size; start_token counts from 0."""
    schema = "window_id int, bin_no long, doc_id long, piece_no int, start_token long, n_tokens long"
    left = windows.filter("capacity_tokens > 0 and window_id is not null").select("window_id", "capacity_tokens").orderBy("window_id")
    out, last = counts.sparkSession.createDataFrame([], schema), None
    while True:
        # pages of the window sizes, so that any number of them is planned
        sizes = (left if last is None else left.filter(F.col("window_id") > last)).limit(AT_ONCE).collect()
        if not sizes:
            return out
        out, last = out.unionByName(_packed(counts, sizes)), sizes[-1].window_id


def _packed(counts: DataFrame, sizes: list) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(int(r.window_id)).alias("window_id"), F.lit(int(r.capacity_tokens)).cast("long").alias("capacity")) for r in sizes])).alias("w")
    docs = counts.select("doc_id", "n_tokens", each).select("doc_id", "n_tokens", "w.*")
    pieces = docs.filter("n_tokens > 0").select(
        "window_id", "capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / F.col("capacity")))).alias("piece_no")
    )
    items = pieces.withColumn("start_token", F.col("piece_no") * F.col("capacity")).withColumn("size", F.least("capacity", F.col("n_tokens") - F.col("start_token")))
    n = counts.count()
    salts = max(8, -(-n // RANKED))
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)))
    parts = cut(items.groupBy("window_id", "capacity", "size", "salt").agg(F.count("*").alias("n_items")))
    histogram = parts.groupBy("window_id", "capacity", "size").agg(F.sum("n_items").alias("n_items"))
    planned = histogram.groupBy("window_id").applyInPandas(_planned, "window_id int, size long, first_rank long, end_rank long, first_bin long, per_bin long")
    ranges = planned.groupBy("window_id", "size").agg(F.sort_array(F.collect_list(F.struct("first_rank", "end_rank", "first_bin", "per_bin"))).alias("ranges"))
    before = parts.select("window_id", "size", "salt", (F.sum("n_items").over(Window.partitionBy("window_id", "size").orderBy("salt")) - F.col("n_items")).alias("before"))
    known = before.join(ranges, ["window_id", "size"])
    order = Window.partitionBy("window_id", "size", "salt").orderBy("doc_id", "piece_no")
    ranked = items.withColumn("nth", F.row_number().over(order) - 1).join(known, ["window_id", "size", "salt"]).withColumn("rank", F.col("before") + F.col("nth"))
    found = F.expr("filter(ranges, r -> r.first_rank <= rank and rank < r.end_rank)[0]")
    placed = ranked.withColumn("r", found).select(
        "window_id", (F.col("r.first_bin") + F.expr("(rank - r.first_rank) div r.per_bin")).alias("bin_no"), "doc_id", F.col("piece_no").cast("int").alias("piece_no"), "start_token", F.col("size").alias("n_tokens")
    )
    none = docs.filter("n_tokens = 0").select("window_id", F.lit(None).cast("long").alias("bin_no"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start_token"), "n_tokens")
    return placed.unionByName(none)


def checked(packed: DataFrame, counts: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, n_docs, n_tokens, within, whole, undivided): what must hold of a packing:
    no bin above its capacity, every document there once with all its tokens in
    pieces one after the other, none divided that fits a window."""
    w = windows.select("window_id", F.col("capacity_tokens").cast("long").alias("capacity"))
    bins = packed.filter("bin_no is not null").groupBy("window_id", "bin_no").agg(F.sum("n_tokens").alias("t")).groupBy("window_id").agg(F.max("t").alias("most"))
    per = packed.groupBy("window_id", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("t"), F.countDistinct("piece_no").alias("d"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    both = per.join(counts.select("doc_id", F.col("n_tokens").alias("own")), "doc_id", "left").join(w, "window_id")
    docs = both.groupBy("window_id").agg(
        F.count("*").alias("n_docs"), F.sum("t").alias("n_tokens"), F.every((F.col("t") == F.col("own")) & (F.col("end") == F.col("own")) & (F.col("k") == F.col("d"))).alias("whole"),
        F.every((F.col("k") == 1) | (F.col("own") > F.col("capacity"))).alias("undivided"),
    )
    return docs.join(bins, "window_id").join(w, "window_id").select("window_id", "n_docs", "n_tokens", (F.col("most") <= F.col("capacity")).alias("within"), "whole", "undivided")


def fill(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, n_bins, n_items, n_tokens, fill): how full the bins are."""
    bins = packed.filter("bin_no is not null").groupBy("window_id", "bin_no").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("t"))
    total = bins.groupBy("window_id").agg(F.count("*").alias("n_bins"), F.sum("k").alias("n_items"), F.sum("t").alias("n_tokens"), F.max("t").alias("most"))
    w = windows.select("window_id", F.col("capacity_tokens").cast("long").alias("capacity"))
    return total.join(w, "window_id").select("window_id", "n_bins", "n_items", "n_tokens", (F.col("n_tokens") / (F.col("n_bins") * F.col("capacity"))).alias("fill"), (F.col("most") <= F.col("capacity")).alias("within"))
