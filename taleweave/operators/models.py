"""Model-backed flows with pluggable models.

A model is a function from a list of prompts to a list of replies; it runs inside an
Arrow function, a batch at a time, created once per task by its factory. Offline the
flows run with replayed or scripted models, as their tests do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from taleweave.functions import text as T

Model = Callable[[list[str]], Iterable[str | None]]


def generated(factory: Callable[[], Model]):
    """A pandas function from prompts to replies. A failing batch is asked prompt by
    prompt, and only the prompts that fail alone give nulls, so that what is lost does
    not depend on batches and partitions."""

    def alone(model: Model, prompt: str):
        try:
            return next(iter(model([prompt])))
        except Exception:
            return None

    @F.pandas_udf(StringType())
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            prompts = s.tolist()
            try:
                replies = list(model(prompts))
            except Exception:
                replies = [alone(model, p) for p in prompts]
            yield pd.Series(replies, index=s.index, dtype=object)

    return reply


def lines(reply: Column) -> Column:
    """Non-blank lines of a reply without list marks."""
    x = F.transform(F.split(F.coalesce(reply, F.lit("")), r"\n"), lambda v: F.trim(F.regexp_replace(v, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.filter(x, lambda v: v != "")


def json_object(reply: Column, schema: str) -> Column:
    """The outermost object in a reply, parsed; null where it is none."""
    return F.from_json(F.regexp_extract(T.unfenced(reply), r"(?s)\{.*\}", 0), schema)


def graded(df: DataFrame, reply: Column, minimum: float = 0.5) -> DataFrame:
    """Keeps rows graded 'score: reason' at minimum or more; unreadable grades pass."""
    score, reason = T.parsed_grade(reply)
    return df.withColumn("grade", score).withColumn("reason", reason).filter(F.col("grade") >= minimum)


def cited_ids(reply: Column, known: Column) -> Column:
    """Source labels a batch grade keeps: none for NONE, all where it is unreadable."""
    got = F.array_distinct(F.regexp_extract_all(F.upper(reply), F.lit(r"S\d+"), F.lit(0)))
    return F.when(F.upper(F.trim(reply)) == "NONE", F.array().cast("array<string>")).when(F.size(F.array_intersect(got, known)) > 0, F.array_intersect(known, got)).otherwise(known)


def judge_score(reply: Column) -> Column:
    """The first number of a reply if it lies in 0..1, else null; a comma may stand
    for the point."""
    x = F.regexp_extract(F.replace(reply, F.lit(","), F.lit(".")), r"-?\d+(?:\.\d+)?", 0)
    v = F.try_to_number(F.nullif(x, F.lit("")), F.lit("S999999.999999")).cast("double")
    return F.when((v >= 0) & (v <= 1), v)


def route(question: Column) -> Column:
    """simple, medium or complex without a model: by length and by joining words."""
    n = F.size(T.words(question))
    many = F.lower(question).rlike(r"(?U)\b(so sánh|compare|tại sao|why|mối quan hệ|relationship)\b")
    return F.when(many | (n > 20), "complex").when(n > 8, "medium").otherwise("simple")


def corrective_action(n_docs: Column, n_relevant: Column) -> Column:
    """correct from half relevant on, incorrect for none (also without documents),
    else ambiguous."""
    return F.when((n_docs == 0) | (n_relevant == 0), "incorrect").when(n_relevant * 2 >= n_docs, "correct").otherwise("ambiguous")


def context_blocks(passages: DataFrame) -> DataFrame:
    """(query_id, context): passages (query_id, rank, source, text) as labelled blocks in
    rank order; a query has a bounded number of passages."""
    block = F.concat(F.lit("[S"), F.col("rank").cast("string"), F.lit("] Source: "), F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    g = passages.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    return g.select("query_id", F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n").alias("context"))


def retried(open_rows: DataFrame, attempt: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]], max_rounds: int) -> DataFrame:
    """A bounded loop over the rows still open: attempt gives (done, still open)."""
    done = None
    for i in range(max_rounds + 1):
        finished, open_rows = attempt(open_rows, i)
        done = finished if done is None else done.unionByName(finished)
        if open_rows.isEmpty():
            break
    return done
