"""Problem 9: mixing sources to target weights.

Temperature mixing. c is the share of a source in all tokens, each source counted as
often as it may be repeated; its weight is c tilted to its target t by an exponent:
w ~ c * (t / c) ** x. x = 1 is the target; at x = 0 every source is repeated to its
limit at once, and between them the greatest repetition grows with x. So the exponent
is bisected to the largest in [0, 1] that keeps the limits. The size of a mix is
`stretch` times the largest at which all targets can be met: at 1 the bisection ends
at the targets themselves, beyond it at the nearest mixture that the limits allow. With a target
entropy the exponent of the plain shares, w ~ q ** x, is bisected to meet it instead.
Sources without documents reach nothing, the others share their part in proportion.

The weights become token budgets, realised as block permutations: every document
gets as many copies as whole passes fit the budget, and the rest is taken from the
documents in an order permuted by blocks. Only block totals are summed in order; the
one block in which the budget ends is decided by documents. Blocks are hashed, their
number follows the size of the source, so a hot source is spread over all tasks.

Defined results: documents with null source or text take part in no mixture; a mix
whose sources are all empty selects nothing; a target of 0 or null selects nothing;
repeated target rows of a source add up, with the least max_repeats; a null
max_repeats counts as 1; repeated documents are chosen each for itself.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.session import cut, small_side

#: Documents in a block, on average.
BLOCK_DOCS = 5_000
#: Halvings of an interval of exponents.
HALVINGS = 80


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisected(holds, low: float, high: float) -> float:
    """The largest exponent between low and high at which a condition holds that holds
    from low up to some exponent; low if it holds nowhere."""
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def _normalised(w: dict[str, float]) -> dict[str, float]:
    n = sum(w.values())
    return {s: v / n for s, v in w.items()}


def temperature_weights(shares: dict[str, float], target_entropy: float) -> tuple[float, dict[str, float]]:
    """(exponent in [0, 4], weights): shares to the power of the exponent, bisected so
    that their entropy meets the target (the nearest possible one beyond)."""
    q = {s: v for s, v in shares.items() if v > 0}
    at = lambda x: _normalised({s: v**x for s, v in q.items()})
    x = bisected(lambda e: entropy(list(at(e).values())) > target_entropy, 0.0, 4.0)
    return x, at(x)


def budgets(targets: list[tuple[str, float, int]], tokens: dict[str, int], stretch: float = 1.0, target_entropy: float | None = None) -> tuple[float, dict[str, tuple[float, float]]]:
    """(exponent, {source: (weight, tokens to select)}) of one mix of (source, share,
    max_repeats); (1, {}) if it has nothing to select."""
    have = {s: (t, r) for s, t, r in targets if t > 0 and tokens.get(s, 0) > 0 and r > 0}
    if not have:
        return 1.0, {}
    t, limit = _normalised({s: v for s, (v, _) in have.items()}), {s: r * tokens[s] for s, (_, r) in have.items()}
    if target_entropy is not None:
        x, w = temperature_weights(_normalised({s: float(tokens[s]) for s in have}), target_entropy)
        return x, {s: (w[s], w[s] * min(limit[z] / w[z] for z in have)) for s in have}
    c = _normalised({s: float(v) for s, v in limit.items()})
    size = min(stretch * min(limit[s] / t[s] for s in have), sum(limit.values()))
    at = lambda x: _normalised({s: c[s] * (t[s] / c[s]) ** x for s in have})
    x = bisected(lambda e: all(v * size <= limit[s] * (1 + 1e-12) for s, v in at(e).items()), 0.0, 1.0)
    w = at(x)
    return x, {s: (w[s], w[s] * size) for s in have}


def _planned(stretch: float, target_entropy: float | None):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("source", ignore_index=True)
        tokens = {s: int(n) for s, n in zip(g["source"], g["tokens"])}
        docs = dict(zip(g["source"], g["docs"]))
        own = [(s, 0.0 if pd.isna(v) else float(v), int(r)) for s, v, r in zip(g["source"], g["share"], g["repeats"])]
        x, want = budgets(own, tokens, stretch, target_entropy)
        repeats = {s: r for s, _, r in own}
        h, goal = entropy([w for w, _ in want.values()]), entropy(list(_normalised({s: v for s, v, _ in own if s in want}).values())) if want else 0.0
        rows = []
        for s, (w, b) in want.items():
            passes = min(math.floor(b / tokens[s] + 1e-9), repeats[s])
            rest = max(0.0, b - passes * tokens[s]) if passes < repeats[s] else 0.0  # nothing above the limit
            rows.append((int(g["mix_id"].iloc[0]), s, x, w, h, goal if target_entropy is None else target_entropy, passes, rest, max(1, -(-int(docs[s]) // BLOCK_DOCS))))
        return pd.DataFrame(rows, columns=["mix_id", "source", "exponent", "weight", "entropy", "target_entropy", "passes", "rest", "n_blocks"])

    return run


def plan(counts: DataFrame, targets: DataFrame, stretch: float = 1.0, target_entropy: float | None = None) -> DataFrame:
    """(mix_id, source, exponent, weight, entropy, target_entropy, passes, rest, n_blocks)
    of the sources to select from: whole passes over a source and the tokens beyond.
    One task sees the sources of one mix."""
    t = targets.filter("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.sum("target_share").alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
    totals = counts.filter("n_tokens > 0 and source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    known = t.join(totals, "source", "left").na.fill(0, ["tokens", "docs"])
    return cut(known.groupBy("mix_id").applyInPandas(_planned(stretch, target_entropy), "mix_id int, source string, exponent double, weight double, entropy double, target_entropy double, passes int, rest double, n_blocks long"))


def select(counts: DataFrame, planned: DataFrame) -> DataFrame:
    """(mix_id, source, doc_id, copies, n_tokens) of the documents chosen by a plan."""
    small = small_side(planned.select("mix_id", "source", "passes", "rest", "n_blocks"))
    placed = counts.filter("n_tokens > 0").join(small, "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("n_blocks")))
    blocks = cut(placed.filter("rest > 0").groupBy("mix_id", "source", "rest", "block").agg(F.sum("n_tokens").alias("t")))
    order = Window.partitionBy("mix_id", "source").orderBy(F.xxhash64("mix_id", "source", "block"), "block")
    summed = blocks.withColumn("upto", F.sum("t").over(order)).select("mix_id", "source", "block", (F.col("upto") - F.col("t")).alias("before"), "upto")
    known = placed.join(summed, ["mix_id", "source", "block"], "left")
    whole = known.filter("upto is null or upto <= rest or before >= rest")
    sure = whole.select("mix_id", "source", "doc_id", "n_tokens", (F.col("passes") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    inside = Window.partitionBy("mix_id", "source").orderBy(F.xxhash64("mix_id", "doc_id"), "doc_id")
    last = known.filter("upto > rest and before < rest").withColumn("sofar", F.col("before") + F.sum("n_tokens").over(inside))
    decided = last.select("mix_id", "source", "doc_id", "n_tokens", (F.col("passes") + F.when(F.col("sofar") - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    return sure.unionByName(decided).filter("copies > 0").select("mix_id", "source", "doc_id", "copies", "n_tokens")


def shares(selected: DataFrame, targets: DataFrame, planned: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, exponent, weight, entropy,
    target_entropy, n_docs, most_copies, tokens, actual_share): the shares really
    reached, also of sources that have none."""
    got = selected.groupBy("mix_id", "source").agg(F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    t = targets.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    all_ = t.join(planned.select("mix_id", "source", "exponent", "weight", "entropy", "target_entropy"), ["mix_id", "source"], "left").join(got, ["mix_id", "source"], "left")
    all_ = all_.na.fill(0, ["n_docs", "most_copies", "tokens", "weight"])
    return all_.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy("mix_id"))), F.lit(0.0)))
