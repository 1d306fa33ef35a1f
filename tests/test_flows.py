"""Model-backed flows with scripted models."""

import json

from pyspark.sql import functions as F

from taleweave.operators import chunking, flows, vector


def script(f):
    return lambda: (lambda prompts: [f(p) for p in prompts])


def docs(spark):
    return spark.createDataFrame([(1, "The fox found a bell. The bell was old."), (2, "A ferryman sold bread."), (3, None)], "key long, text string")


def test_headers_and_neighbours(spark):
    c = spark.createDataFrame([(1, 0, "one"), (1, 1, "two"), (2, 0, "three")], "key long, chunk_index int, chunk string")
    s = spark.createDataFrame([(1, "A tale")], "key long, summary string")
    got = {(r.key, r.chunk_index): r.chunk for r in flows.with_headers(c, s).collect()}
    assert got == {(1, 0): "A tale\nSection 1\n\none", (1, 1): "A tale\nSection 2\n\ntwo", (2, 0): "Section 1\n\nthree"}
    n = {(r.key, r.chunk_index): r.chunk for r in flows.with_neighbours(c, script(lambda p: "ctx" if "Before:\none" in p else None)).collect()}
    assert n[1, 1] == "ctx\n\ntwo" and n[1, 0] == "one"


def test_propositions(spark):
    got = flows.propositions(docs(spark), "key", "text", script(lambda p: "- a\n- b\n- c"), script(lambda p: "yes" if p.endswith("b") else "no"), size=2).collect()
    assert {(r.key, r.chunk) for r in got} == {(1, "b"), (2, "b")}


def test_raptor_levels(spark):
    leaves = chunking.chunk(spark.createDataFrame([(1, "word " * 200)], "key long, text string"), "key", "text", "recursive", size=60, overlap=0)
    embed = lambda df: df.select("node_id", F.array(F.length("text").cast("float")).alias("embedding"))
    t = flows.raptor(leaves, script(lambda p: "sum " + str(len(p))), embed)
    n = {r.level: r["count"] for r in t.groupBy("level").count().collect()}
    assert n[0] == leaves.count() and 1 <= n[1] <= n[0] // 2
    assert all(len(r.children) > 1 for r in t.filter("level > 0").collect())


def test_like_chunks_meet(spark):
    rows = [(1, i, ("fox bell river " if i % 2 else "bread oven flour ") * 3 + "x" * (i // 4)) for i in range(8)]
    leaves = spark.createDataFrame(rows, "key long, chunk_index int, chunk string")
    embed = lambda df: df.select("node_id", F.array(F.col("text").contains("fox").cast("double"), F.lit(0.0)).alias("embedding"))
    t = flows.raptor(leaves, script(lambda p: p.replace("Summarise:\n", "")), embed, levels=1).filter("level = 1").collect()
    assert t and all(("fox" in r.text) != ("bread" in r.text) for r in t)


def test_cards_are_reused(spark):
    asked = script(lambda p: "new card")
    d = docs(spark).filter("text is not null")
    old = d.filter("key = 1").select("key", F.sha2("text", 256).alias("sha256"), F.lit("old card").alias("card"))
    assert {(r.key, r.card) for r in flows.document_cards(d, old, asked).collect()} == {(1, "old card"), (2, "new card")}


def test_extraction_needs_every_unit(spark):
    reply = json.dumps({"entities": [{"name": "Fox", "type": "Creature", "description": "red"}], "relationships": [{"source": "Fox", "target": "Bell", "description": "found"}, {"source": "Fox", "target": "fox", "description": "self"}]})
    got = flows.extracted_graphs(docs(spark), script(lambda p: reply if "fox" in p else "not json")).collect()
    assert [r.key for r in got] == [1]
    assert [(e.name, e.type) for e in got[0].entities] == [("Bell", "other"), ("Fox", "creature")]
    assert [(r.source, r.target) for r in got[0].relationships] == [("Fox", "Bell")]


def test_answers_and_check(spark):
    corpus = spark.createDataFrame([(10, "the fox found a bell"), (11, "bread for sale"), (12, "a ferry")], "id long, text string")
    q = spark.createDataFrame([(1, "who found the bell"), (2, "zzz")], "query_id long, question string")
    hits = flows.search(q, corpus, 2)
    top = hits.filter("query_id = 1 and rank = 1").first()
    assert top.id == 10
    a = {r.query_id: r for r in flows.checked(flows.answers(q, hits.filter("query_id = 1"), corpus, script(lambda p: "The fox [S1] [S9]")), script(lambda p: '{"grounded": true}')).collect()}
    assert a[1].cited == ["S1"] and a[1].invalid == ["S9"] and a[1].grounded
    assert a[2].answer == flows.NO_CONTEXT and not a[2].grounded


def test_hypothetical_and_agentic(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, question string")
    h = {r.query_id: (r.question, r.asked) for r in flows.hypothetical(q, script(lambda p: "x" if p.endswith("a") else None)).collect()}
    assert h == {1: ("x", "a"), 2: ("b", "b")}
    retrieve = lambda df: df.filter("question like '%!%' or query_id = 1").select("query_id", F.lit(7).alias("id"), F.lit(1).alias("rank"))
    got = {(r.query_id, r.round) for r in flows.agentic(q, retrieve, script(lambda p: p.split("\n")[1] + "!")).collect()}
    assert got == {(1, 0), (2, 1)}


def test_compression_and_metadata(spark):
    h = spark.createDataFrame([(1, 1, "q", "long text"), (1, 2, "q", "noise"), (1, 3, "q", "kept")], "query_id long, id long, question string, text string")
    got = {r.id: r.text for r in flows.compressed(h, script(lambda p: "NONE" if "noise" in p else None if "kept" in p else "short")).collect()}
    assert got == {1: "short", 3: "kept"}
    c = spark.createDataFrame([(1, "Anna Lee met Bob Ray."), (2, "x")], "key long, chunk string")
    m = {r.key: r for r in flows.enhanced(c, script(lambda p: '{"characters": ["Z"], "topic": "t"}' if p.endswith("x") else "?")).collect()}
    assert m[1].characters == ["Anna Lee", "Bob Ray"] and m[2].characters == ["Z"] and m[2].topic == "t"


def test_hash_embeddings(spark):
    r = vector.hash_embeddings(spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, text string"), "id").orderBy("id").collect()
    assert abs(sum(x * x for x in r[0].embedding) - 1) < 1e-6 and sum(r[1].embedding) == 0 and len(r[2].embedding) == 256


def test_rewrite_only_without_accents(spark):
    q = spark.createDataFrame([(1, "Thạch Sanh là ai"), (2, "thach sanh la ai"), (3, None)], "query_id long, question string")
    got = {r.query_id: (r.question, r.asked) for r in flows.rewritten(q, script(lambda p: "new")).collect()}
    assert got == {1: ("Thạch Sanh là ai", "Thạch Sanh là ai"), 2: ("new", "thach sanh la ai"), 3: (None, None)}
    assert {r.question for r in flows.rewritten(q.filter("query_id < 3"), script(lambda p: "new"), "always").collect()} == {"new"}


def test_questions_of_chunks(spark):
    c = spark.createDataFrame([(1, "the fox found a bell"), (2, "bread for sale")], "id long, text string")
    index = flows.hype_index(c, script(lambda p: "who found the bell\nwhat did the fox do" if "fox" in p else "1. where is bread sold"))
    q = spark.createDataFrame([(7, "where is bread sold"), (8, "who found the bell")], "query_id long, question string")
    assert {(r.query_id, r.id) for r in flows.hype_search(q, index, 1).collect()} == {(7, 2), (8, 1)}


def test_variations_and_strategies(spark):
    q = spark.createDataFrame([(1, "fox"), (2, "bell")], "query_id long, question string")
    v = flows.model_variations(q, script(lambda p: "fox\n- red fox\n- vixen" if p.endswith("fox") else ""), 2).collect()
    assert [r.query for r in v if r.query_id == 1] == ["fox", "red fox", "vixen"] and any(r.query == "bell?" for r in v)
    first, second = (lambda d, k=k: d.filter(f"query_id >= {k}").select("query_id", F.lit(k).alias("id"), F.lit(1).alias("rank")) for k in (2, 1))
    assert {(r.query_id, r.id) for r in flows.first_that_finds(q, [first, second]).collect()} == {(2, 2), (1, 1)}
    assert [r.query_id for r in flows.poor(q, first(q)).collect()] == [1]


def test_answers_until_grounded(spark):
    corpus = spark.createDataFrame([(10, "the fox found a bell")], "id long, text string")
    q = spark.createDataFrame([(1, "who found the bell"), (2, "none")], "query_id long, question string")
    hits = spark.createDataFrame([(1, 10, 1)], "query_id long, id long, rank int")
    got = {r.query_id: r for r in flows.self_checked(q, hits, corpus, script(lambda p: "The fox [S1]"), script(lambda p: '{"grounded": false}'), 1).collect()}
    assert got[1].round == 1 and not got[1].grounded and got[2].answer == flows.NO_CONTEXT and got[2].round == 0
