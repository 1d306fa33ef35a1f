"""Normalising, fusing, reranking and expanding ranked lists.

Lists are tables (query_id, id, score[, rank]); ties always break by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_max(df: DataFrame, score: str = "score", by: str = "query_id", lower_is_better: bool = False) -> DataFrame:
    """Adds norm in [0, 1]; lists of equal scores get 1."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    gain = (high - F.col(score)) if lower_is_better else (F.col(score) - low)
    return df.withColumn("norm", F.when(high == low, 1.0).otherwise(gain / (high - low)))


def hybrid(lexical: DataFrame, vectors: DataFrame, k: int, weight_lexical: float | None = None, weight_vector: float | None = None) -> DataFrame:
    """Min-max normalised scores, weighted (.3 and .7 by default) over the full outer
    join of both lists, best k: (query_id, id, score, rank)."""
    a = 0.3 if weight_lexical is None else weight_lexical
    b = 0.7 if weight_vector is None else weight_vector
    x = min_max(lexical).select("query_id", "id", F.col("norm").alias("x"))
    y = min_max(vectors).select("query_id", "id", F.col("norm").alias("y"))
    both = x.join(y, ["query_id", "id"], "full_outer").select("query_id", "id", F.round(F.coalesce("x", F.lit(0.0)) * a + F.coalesce("y", F.lit(0.0)) * b, 6).alias("score"))
    return ranked(both, k)


def ranked(df: DataFrame, k: int | None = None, by: str = "query_id", key: str = "id") -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key)))
    return out if k is None else out.filter(F.col("rank") <= max(k, 0))


def rrf(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists with 1-based ranks."""
    every = lists[0].select("query_id", "id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "id", "rank"))
    return ranked(every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score")), k)


def first_parents(hits: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """Hits on children (query_id, id, rank) become their parents, the best rank
    first, at most k; hits without a link pass through as they are."""
    x = hits.join(links.select(F.col("child_id").alias("id"), "parent_id"), "id", "left").select("query_id", F.coalesce(F.col("parent_id").cast("string"), F.col("id").cast("string")).alias("id"), "rank")
    best = x.groupBy("query_id", "id").agg(F.min("rank").alias("best"))
    w = Window.partitionBy("query_id").orderBy("best", "id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rerank(hits: DataFrame, score: Column | Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """Hits scored anew by a Column (or a function that adds relevance_score), best k."""
    scored = hits.withColumn("relevance_score", score) if isinstance(score, Column) else score(hits)
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def shared_words(query_words: Column, text_words: Column) -> Column:
    """Offline stand-in for a cross-encoder: the number of distinct shared words."""
    return F.size(F.array_intersect(query_words, text_words)).cast("double")


def relevant(df: DataFrame, minimum: float, score: str = "relevance_score") -> DataFrame:
    """Keeps scores of at least minimum; a missing score passes."""
    return df.filter(F.coalesce(F.col(score), F.lit(minimum)) >= minimum)


def competing(passages: DataFrame, extras: DataFrame, k: int, caps: dict[str, int]) -> DataFrame:
    """Extras (query_id, id, kind, score) join the passages only where they outrank one
    of the best k; every kind competes alone and has its own cap."""
    out = ranked(passages, k).select("query_id", "id", F.lit("passage").alias("kind"), "score")
    for kind, cap in caps.items():
        own = extras.filter(F.col("kind") == kind).select("query_id", "id", "score", "kind")
        both = passages.select("query_id", "id", "score", F.lit("passage").alias("kind")).unionByName(own)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("kind"), "id")
        in_top = both.withColumn("r", F.row_number().over(w)).filter((F.col("r") <= k) & (F.col("kind") == kind))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("r"))
        out = out.unionByName(in_top.withColumn("n", nth).filter(F.col("n") <= cap).select("query_id", "id", "kind", "score"))
    return out


def variations(queries: DataFrame, key: str, text: str, n: int = 3, vietnamese: bool = True) -> DataFrame:
    """(query_id, variation_no, query): the question and template variations of it."""
    q = F.col(text)
    forms = F.array(q, F.concat(q, F.lit("?")), F.concat(q, F.lit(" là gì?")) if vietnamese else F.concat(F.lit("What is "), q, F.lit("?")), F.concat(F.lit("Giải thích " if vietnamese else "Explain "), q))
    return queries.select(F.col(key).alias("query_id"), F.posexplode(F.slice(F.array_distinct(forms), 1, n + 1)).alias("variation_no", "query"))
