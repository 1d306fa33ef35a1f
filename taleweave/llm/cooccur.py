"""Problem 2: items that appear together.

Basket collapsing: items that cannot reach the asked support are dropped first
(exact for the pairs of that support, as a pair is never more frequent than its
items), equal baskets collapse to one weighted array, pairs are enumerated once per
distinct basket and their weights summed before the shuffle.

With a share, a basket holds frequent items only, of which there are at most basket
size / min_share, so no group grows with the data however hot one id is. Without
support (`min_support=1, min_share=0`) every item stays and every pair that occurs
is counted; a basket then is one array of all its distinct items.

Defined results: null ids form no basket; null elements and labels that are empty
after normalising are ignored; repeated rows and elements count once; ids without
items count for N only; a tie of the score orders by the item names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL_KINDS = (("motif", "motifs"), ("moral", "morals"))


def label(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "_")


def written_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def basket_items(stories: DataFrame) -> DataFrame:
    """(basket, item), one row per element, not yet distinct."""
    none = F.array().cast("array<string>")

    def items(column: str, kind: str, form) -> Column:
        return F.transform(F.coalesce(F.col(column), none), lambda x: F.when(F.length(form(x)) > 0, F.concat(F.lit(kind + ":"), form(x))))

    arrays = [items(column, kind, label) for kind, column in LABEL_KINDS] + [items("characters", "character", written_name)]
    held = stories.filter("story_id is not null").select(F.col("story_id").alias("basket"), F.explode(F.concat(*arrays)).alias("item"))
    return held.filter("item is not null")


def pairs(stories: DataFrame, min_support: int = 5, min_share: float = 1 / 500, min_lift: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, n_baskets, lift, conviction) of the pairs
    with n_ab >= min_support and n_ab >= min_share * N and lift >= min_lift; with a
    support of 1 and no share, of all pairs that occur."""
    n = stories.filter("story_id is not null").select("story_id").distinct().agg(F.count("*").alias("n")).first().n
    need = max(min_support, -(-n // round(1 / min_share)) if min_share else 0)
    held = basket_items(stories).distinct()
    frequent = held.groupBy("item").agg(F.count("*").alias("n_item")).filter(F.col("n_item") >= need)
    # AQE broadcasts this side only if its measured size is under the threshold
    baskets = held.join(frequent.select("item"), "item").groupBy("basket").agg(F.sort_array(F.collect_set("item")).alias("items"))
    distinct = baskets.filter(F.size("items") > 1).groupBy("items").agg(F.count("*").alias("weight"))
    firsts = distinct.select(F.posexplode("items").alias("i", "item_a"), "items", "weight").filter(F.col("i") < F.size("items") - 1)
    both = firsts.select("item_a", F.explode(F.expr("slice(items, i + 2, size(items))")).alias("item_b"), "weight")
    counted = both.groupBy("item_a", "item_b").agg(F.sum("weight").alias("n_ab")).filter(F.col("n_ab") >= need)
    a, b = (frequent.select(F.col("item").alias(f"item_{x}"), F.col("n_item").alias(f"n_{x}")) for x in "ab")
    total = F.lit(n).cast("long")
    scored = counted.join(a, "item_a").join(b, "item_b").select(
        "item_a", "item_b", "n_a", "n_b", "n_ab", total.alias("n_baskets"),
        (F.col("n_ab") * total / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        F.when(F.col("n_ab") < F.col("n_a"), (1 - F.col("n_b") / total) / (1 - F.col("n_ab") / F.col("n_a"))).alias("conviction"),
    )
    return scored.filter((F.col("n_ab") * total).cast("double") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
