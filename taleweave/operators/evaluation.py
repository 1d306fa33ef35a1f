"""Retrieval and answer metrics, comparison of reports, quality gate, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions import text as T

LOWER_IS_BETTER = ("latency_p50", "latency_p95", "false_abstention_rate", "llm_calls", "errors")


def retrieval_scores(retrieved: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(case_id, precision, recall, mrr, ndcg) of ranked sources (case_id, rank, source)
    against expected ones (case_id, source). A source earns gain at its first place
    only; precision divides by what was retrieved; cases without expectation get 0."""
    top = retrieved.filter(F.col("rank") <= k)
    hit = top.join(expected.select("case_id", "source").distinct().withColumn("hit", F.lit(1)), ["case_id", "source"], "left")
    first = F.row_number().over(Window.partitionBy("case_id", "source").orderBy("rank"))
    gain = F.when((F.col("hit") == 1) & (F.col("nth") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = hit.withColumn("nth", first).groupBy("case_id").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.countDistinct(F.when(F.col("hit") == 1, F.col("source"))).alias("found"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_rank"), F.sum(gain).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    want = expected.select("case_id", "source").distinct().groupBy("case_id").agg(F.count("*").alias("wanted"))
    every = retrieved.select("case_id").union(expected.select("case_id")).distinct()
    x = every.join(per, "case_id", "left").join(want, "case_id", "left").na.fill(0, ["n", "hits", "found", "wanted", "dcg"])
    return x.select(
        "case_id", F.round(F.col("hits") / F.greatest("n", F.lit(1)), 6).alias("precision"), F.round(F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).otherwise(0.0), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"), F.round(F.when(F.col("wanted") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


def evidence_recall(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, evidence_recall): the share of phrases (case_id, phrase, normalised)
    contained in a retrieved text (case_id, text); null without phrases."""
    both = evidence.join(chunks, "case_id", "left").groupBy("case_id", "phrase").agg(F.max(F.coalesce(F.col("text").contains(F.col("phrase")), F.lit(False)).cast("int")).alias("hit"))
    return both.groupBy("case_id").agg(F.round(F.avg("hit"), 6).alias("evidence_recall"))


def token_recall(answer_words, reference_words):
    """Share of the distinct reference words in the answer; null without reference."""
    ref = F.array_distinct(reference_words)
    return F.when(F.size(ref) > 0, F.size(F.array_intersect(ref, answer_words)) / F.size(ref))


def by_tag(cases: DataFrame, tags: str, metrics: list[str]) -> DataFrame:
    """Mean of each metric per tag, with the number of cases."""
    return cases.withColumn("tag", F.explode(tags)).groupBy("tag").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def percentiles(df: DataFrame, value: str, *qs: float, by: list[str] | None = None) -> DataFrame:
    """Linear interpolated percentiles, 0 for no values."""
    return df.groupBy(*(by or [])).agg(*[F.round(F.coalesce(F.percentile(value, F.lit(q / 100)), F.lit(0.0)), 6).alias(f"p{q:g}") for q in qs])


def long_report(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per metric: (keys, metric, value)."""
    return df.unpivot(keys, metrics, "metric", "value")


def compare(new: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Status of each metric against a baseline: better, worse or same within 1e-9."""
    x = new.withColumnRenamed("value", "current").join(base.withColumnRenamed("value", "baseline"), [*keys, "metric"])
    d = F.col("current") - F.col("baseline")
    good = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -d).otherwise(d)
    return x.withColumn("delta", F.round(d, 6)).withColumn("status", F.when(F.abs(d) <= 1e-9, "same").when(good > 0, "better").otherwise("worse"))


def gate(compared: DataFrame, base: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Failures: worse by more than the tolerance, or configurations that are missing."""
    worse = compared.filter((F.col("status") == "worse") & (F.abs("delta") > tolerance + 1e-9)).select(*keys, "metric", F.lit("worse").alias("reason"))
    missing = base.select(*keys, "metric").join(compared, [*keys, "metric"], "left_anti").select(*keys, "metric", F.lit("missing").alias("reason"))
    return worse.unionByName(missing)


def calibration(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, kept, kept_relevant, dropped_relevant, kept_share) of scored rows
    (score, relevant): every row meets the bounded list of thresholds in its own task."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    keep = F.col("score") >= F.col("threshold")
    rel = F.col("relevant").cast("int")
    return scored.select("score", "relevant", t).groupBy("threshold").agg(
        F.sum(keep.cast("int")).alias("kept"), F.sum(F.when(keep, rel).otherwise(0)).alias("kept_relevant"), F.sum(F.when(~keep, rel).otherwise(0)).alias("dropped_relevant"), F.round(F.avg(keep.cast("int")), 6).alias("kept_share")
    )


def answer_cases(answers: DataFrame) -> DataFrame:
    """Answers (case_id, question, answerable, reference, answer, tags, calls, latency_ms,
    error) judged: abstained, cited, answer_recall. A null answer is an empty one; recall
    and citation are null for cases that have no answer."""
    a = F.coalesce("answer", F.lit(""))
    own = F.col("answerable")
    return answers.select(
        "*", T.is_abstention(a).alias("abstained"), F.when(own, a.rlike(r"\[S\d+\]")).alias("cited"), F.when(own, token_recall(T.words(a), T.words(F.col("reference")))).alias("answer_recall")
    )


def answer_summary(cases: DataFrame) -> DataFrame:
    """One row: numbers of cases, mean recall, citation and false abstention rate of the
    answerable ones, abstention accuracy of the others, calls, latencies and errors."""
    own, other = F.col("answerable"), ~F.col("answerable")
    rate = lambda c, of: F.round(F.avg(F.when(of, c.cast("double"))), 6)
    return cases.agg(
        F.count("*").alias("cases"), F.count(F.when(own, 1)).alias("answerable_cases"), F.count(F.when(other, 1)).alias("unanswerable_cases"),
        F.round(F.avg(F.when(own, F.col("answer_recall"))), 6).alias("answer_recall"), rate(F.col("cited"), own).alias("citation_rate"), rate(F.col("abstained"), own).alias("false_abstention_rate"),
        rate(F.col("abstained"), other).alias("abstention_accuracy"), F.round(F.avg("calls"), 6).alias("llm_calls_per_query"),
        *[F.round(F.coalesce(F.percentile("latency_ms", F.lit(q / 100)), F.lit(0.0)), 6).alias(f"latency_p{q}_ms") for q in (50, 95)], F.count("error").alias("errors"),
    )


def answer_by_tag(cases: DataFrame) -> DataFrame:
    """(tag, n, answer_recall, false_abstention_rate) of the answerable cases."""
    x = cases.filter("answerable").select(F.explode("tags").alias("tag"), "answer_recall", F.col("abstained").cast("double").alias("abstained"))
    return x.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg("answer_recall"), 6).alias("answer_recall"), F.round(F.avg("abstained"), 6).alias("false_abstention_rate"))
