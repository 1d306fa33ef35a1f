"""Searches must not write more than they read: neither the words of the texts nor the
pairs of a question and a text, of which there are the product of both numbers."""

import os

import duckdb
import pytest

from taleweave.plans import queries as core


@pytest.fixture(scope="module")
def larger(spark, data, tmp_path_factory):
    """The documents ten times with shifted keys, and the bytes of their texts."""
    folder = tmp_path_factory.mktemp("larger")
    c = duckdb.connect()
    n = c.execute(f"select max(doc_id) // 100 * 100 + 100 from '{data}/documents.parquet'").fetchone()[0]
    c.execute(f"copy (select d.* replace (doc_id + i * {n} as doc_id) from '{data}/documents.parquet' d, range(10) r(i)) to '{folder}/documents.parquet' (format parquet)")
    return str(folder), c.execute(f"select sum(strlen(text)) from '{folder}/documents.parquet'").fetchone()[0]


def _checkpoints(context) -> int:
    got = context._jsc.sc().getCheckpointDir()
    folder = got.get().removeprefix("file:") if got.isDefined() else ""
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def _shuffled(context) -> int:
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["bm25_folded", "evidence_recall", "bm25_filtered", "multi_query_rrf", "bm25_topk", "hybrid_fusion", "parent_expand", "rrf_fusion", "cards_compete", "hybrid_search", "rerank_overlap"])
def test_search_writes_less_than_its_texts(spark, larger, name):
    folder, size = larger
    before = _checkpoints(spark.sparkContext) + _shuffled(spark.sparkContext)
    core.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    written = _checkpoints(spark.sparkContext) + _shuffled(spark.sparkContext) - before
    assert written < size, f"{written / size:.2f} x"


def test_best_equals_the_top_of_all_scores(spark):
    from taleweave.operators import lexical

    rows = [(i, " ".join(w for w, m in zip("abcdef", (1, 2, 3, 5, 7, 60)) if i % m == 0)) for i in range(1, 61)]
    docs = spark.createDataFrame([*rows, (61, "f f a"), (62, ""), (63, None)], "id long, text string").repartition(3)
    # half of the texts of the second index hold b, so that its weight is 0; each is found all the same
    for d in (docs, spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "b c"), (4, "c d")], "id long, text string"), docs.selectExpr("concat('k', id) as id", "text")):
        q = spark.createDataFrame([(n, w) for n, words in {1: "a", 2: "abc", 3: "cba", 4: "ffd", 5: "z"}.items() for w in words], "query_id long, term string")
        index = lexical.Index(d, "id")
        for k in (3, 500, 0):
            want = lexical.top_k(index.search(q), k)
            assert sorted(map(tuple, index.best(q, k).select("query_id", "id", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "id", "score", "rank").collect()))


def test_texts_left_out_still_count_for_weights(spark):
    from taleweave.operators import lexical

    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a c", None), (3, "d e", "x"), (4, "f", "y")], "id long, text string, s string")
    q = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, term string")
    from pyspark.sql import functions as F

    every = {r.id: r.score for r in lexical.best_texts(docs, "id", "text", q, 5).collect()}
    assert {r.id: r.score for r in lexical.best_texts(docs, "id", "text", q, 5, kept=F.col("s") == "x").collect()} == {1: every[1]}
