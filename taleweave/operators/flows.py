"""Model-backed dataflows: every model is a factory for models.generated, so the plans
are the same with a served model, a replayed one or a script.

Prompts are short and plain; a reply that cannot be used leaves the row as the
docstring says, and never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions import text as T
from taleweave.operators import chunking, fusion, lexical, models, vector
from taleweave.session import cut

Factory = Callable[[], models.Model]


def _ask(prompt: Column, factory: Factory) -> Column:
    return models.generated(factory)(prompt)


# ------------------------------------------------------------------ chunks


def with_headers(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chunks (key, chunk_index, chunk) prefixed by the summary of their document (key,
    summary) and their number; a missing summary leaves the number alone."""
    head = F.concat_ws("\n", "summary", F.concat(F.lit("Section "), (F.col("chunk_index") + 1).cast("string")))
    return chunks.join(summaries, "key", "left").withColumn("original", F.col("chunk")).withColumn("chunk", F.concat(head, F.lit("\n\n"), "chunk")).drop("summary")


def with_neighbours(chunks: DataFrame, factory: Factory) -> DataFrame:
    """Chunks (key, chunk_index, chunk) with a sentence of context asked for each from its
    neighbours, before the text; without a reply the chunk stays as it is."""
    w = Window.partitionBy("key").orderBy("chunk_index")
    none = F.lit("")
    prompt = F.concat(F.lit("Before:\n"), F.coalesce(F.lag("chunk").over(w), none), F.lit("\n\nText:\n"), F.col("chunk"), F.lit("\n\nAfter:\n"), F.coalesce(F.lead("chunk").over(w), none), F.lit("\n\nSay in one sentence what the text is about."))
    x = chunks.withColumn("original", F.col("chunk")).withColumn("context", _ask(prompt, factory))
    return x.withColumn("chunk", F.concat_ws("\n\n", "context", "original"))


def propositions(docs: DataFrame, key: str, text: str, factory: Factory, judge: Factory | None = None, size: int = 10, least: int = 3) -> DataFrame:
    """(key, group_no, chunk): statements of each text, one per reply line, kept if the
    judge says yes (the first few if it keeps none), in groups of size."""
    p = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), models.lines(_ask(F.concat(F.lit("List the facts, one a line:\n"), text), factory)).alias("ls"))
    e = cut(p.select("key", F.posexplode("ls").alias("pos", "line")))
    if judge is not None:
        e = cut(e.withColumn("ok", F.coalesce(F.lower(_ask(F.concat(F.lit("Is this clear alone? yes or no:\n"), "line"), judge)).rlike("yes|có|đúng"), F.lit(True))))
        any_ok = F.max("ok").over(Window.partitionBy("key"))
        e = e.withColumn("any_ok", any_ok).filter("ok or (not any_ok and pos < " + str(least) + ")")
    n = F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1
    g = e.withColumn("group_no", F.floor(n / size).cast("int")).groupBy("key", "group_no").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("x"))
    return g.select("key", "group_no", F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("chunk"))


def _kmeans(v: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Cluster numbers of rows: centres begin at the first row and the rows farthest from
    those taken, so the result depends on the order of the rows alone."""
    centres = [0]
    far = ((v - v[0]) ** 2).sum(1)
    while len(centres) < k:
        centres.append(int(far.argmax()))
        far = np.minimum(far, ((v - v[centres[-1]]) ** 2).sum(1))
    c = v[centres].copy()
    out = np.zeros(len(v), dtype=np.int64)
    for r in range(rounds):
        near = (((v[:, None, :] - c[None, :, :]) ** 2).sum(2)).argmin(1)
        if r and (near == out).all():
            break
        out = near
        for i in range(k):
            if (out == i).any():
                c[i] = v[out == i].mean(0)
    return out


#: Nodes of one key that are clustered together.
CLUSTERED = 256


def clustered(nodes: DataFrame) -> DataFrame:
    """(key, node_id, group_no) of nodes (key, node_id, i, embedding): k-means with half as
    many clusters as nodes, over runs of CLUSTERED nodes of a key in the order of i."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i", ignore_index=True)
        v = np.array(g["embedding"].tolist(), dtype=np.float64)
        no = _kmeans(v, max(1, len(v) // 2))
        return pd.DataFrame({"key": g["key"], "node_id": g["node_id"], "group_no": no + CLUSTERED * g["part"]})

    x = nodes.withColumn("part", F.floor(F.col("i") / CLUSTERED).cast("long"))
    return x.groupBy("key", "part").applyInPandas(run, f"key {nodes.schema['key'].dataType.simpleString()}, node_id string, group_no long")


def raptor(leaves: DataFrame, factory: Factory, embed: Callable[[DataFrame], DataFrame], levels: int = 3, cap: int = 3000) -> DataFrame:
    """(node_id, level, text, children): leaves (key, chunk_index, chunk) of one key are
    clustered by their embeddings and each cluster of two or more is summarised, level by
    level, until none is left. Summaries that fail drop their cluster; all levels are
    returned."""
    base = leaves.select("key", F.substring(F.sha1(F.concat_ws("|", F.col("key").cast("string"), F.col("chunk_index").cast("string"), "chunk")), 1, 20).alias("node_id"), F.col("chunk_index").cast("long").alias("i"), F.lit(0).alias("level"), F.col("chunk").alias("text"), F.array().cast("array<string>").alias("children"))
    every, now = base.drop("i"), base
    for level in range(1, levels + 1):
        placed = now.join(embed(now.select("node_id", "text")), "node_id").select("key", "node_id", "i", "embedding")
        runs = now.join(clustered(placed), ["key", "node_id"]).groupBy("key", "group_no").agg(F.array_sort(F.collect_list(F.struct("i", "node_id", "text"))).alias("x")).filter(F.size("x") > 1)
        joined = F.substring(F.array_join(F.transform("x", lambda s: s["text"]), "\n\n"), 1, cap)
        up = runs.select("key", "group_no", F.transform("x", lambda s: s["node_id"]).alias("children"), _ask(F.concat(F.lit("Summarise:\n"), joined), factory).alias("text")).filter("trim(text) <> ''")
        now = cut(up.select("key", F.substring(F.sha1(F.array_join("children", "|")), 1, 20).alias("node_id"), F.col("group_no").alias("i"), F.lit(level).alias("level"), "text", "children"))
        if now.isEmpty():
            break
        every = every.unionByName(now.drop("i"))
    return every


# ------------------------------------------------------------------ cards and graphs


def document_cards(docs: DataFrame, old: DataFrame, factory: Factory, cap: int = 20_000) -> DataFrame:
    """(key, sha256, card): a card per document (key, text), asked only where the text has
    changed since the old cards; a failed reply keeps the old card, if there is one."""
    x = docs.select("key", F.sha2("text", 256).alias("sha256"), F.substring("text", 1, cap).alias("text")).join(old.select("key", F.col("sha256").alias("old_sha"), F.col("card").alias("old_card")), "key", "left")
    same = x.filter("old_sha = sha256").select("key", "sha256", F.col("old_card").alias("card"))
    new = x.filter("old_sha is null or old_sha <> sha256").select("key", "sha256", F.coalesce(_ask(F.concat(F.lit("Write a card for:\n"), "text"), factory), "old_card").alias("card"))
    return same.unionByName(new)


EXTRACTION = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,description:string>>"


def extracted_graphs(docs: DataFrame, factory: Factory, size: int = 4000) -> DataFrame:
    """(key, entities, relationships) of documents (key, text): units of paragraphs are
    asked one by one; a document counts only if every unit of it could be read. Ends
    of relations that are no entity are added as other; self-relations are dropped."""
    units = chunking.chunk(docs, "key", "text", "paragraphs", size=size)
    read = cut(units.select("key", models.json_object(_ask(F.concat(F.lit("Extract entities and relationships as JSON:\n"), "chunk"), factory), EXTRACTION).alias("g")))
    whole = read.groupBy("key").agg(F.min(F.col("g.entities").isNotNull()).alias("all_read")).filter("all_read").select("key")
    good = read.join(whole, "key", "left_semi")
    e = good.select("key", F.explode("g.entities").alias("x")).select("key", T.match_key(F.col("x.name")).alias("id"), F.col("x.name").alias("name"), F.lower(F.col("x.type")).alias("type"), F.col("x.description").alias("description"))
    r = good.select("key", F.explode(F.coalesce("g.relationships", F.array().cast("array<struct<source:string,target:string,description:string>>"))).alias("x")).select("key", "x.source", "x.target", F.col("x.description").alias("description")).filter("lower(source) <> lower(target)")
    ends = r.select("key", F.explode(F.array("source", "target")).alias("name")).select("key", T.match_key(F.col("name")).alias("id"), "name", F.lit("other").alias("type"), F.lit(None).cast("string").alias("description"))
    rank = F.when((F.col("type") == "other") | F.col("type").isNull(), 1).otherwise(0)
    best = e.unionByName(ends).filter("id <> ''").groupBy("key", "id").agg(F.min(F.struct(rank.alias("r"), "name", F.coalesce("type", F.lit("other")).alias("type"))).alias("m"), F.array_join(F.sort_array(F.collect_set("description")), " ").alias("description"))
    es = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("m.name").alias("name"), F.col("m.type").alias("type"), "description"))).alias("entities"))
    rs = r.distinct().groupBy("key").agg(F.sort_array(F.collect_list(F.struct("source", "target", "description"))).alias("relationships"))
    return whole.join(es, "key", "left").join(rs, "key", "left")


# ------------------------------------------------------------------ answers


def search(questions: DataFrame, corpus: DataFrame, k: int, candidates: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): hybrid search of questions (query_id, question) over a
    corpus (id, text)."""
    n = candidates or 4 * k
    words = lexical.top_k(lexical.bm25_of_texts(corpus, "id", "text", questions.select("query_id", F.explode(T.words(F.col("question"))).alias("term"))), n)
    near = vector.top_k(vector.hash_embeddings(questions, "query_id", "question"), vector.hash_embeddings(corpus, "id", "text"), n, "id", "id", n_queries=questions.count(), n_corpus=corpus.count())
    return fusion.hybrid(words, near, k)


def hypothetical(questions: DataFrame, factory: Factory) -> DataFrame:
    """Questions whose search text is a hypothetical answer; the question where no reply
    comes. The question itself is kept for reranking."""
    reply = _ask(F.concat(F.lit("Answer as if you knew:\n"), "question"), factory)
    return cut(questions.withColumn("asked", F.col("question")).withColumn("question", F.coalesce(reply, "question")))


NO_CONTEXT = "Không có thông tin trong tài liệu."


def answers(questions: DataFrame, hits: DataFrame, corpus: DataFrame, factory: Factory) -> DataFrame:
    """(query_id, context, answer, cited, invalid): one prompt per question from its
    passages; without passages the fixed answer, and the model is not asked."""
    p = hits.join(corpus.select("id", F.col("id").cast("string").alias("source"), "text"), "id").select("query_id", "rank", "source", "text")
    x = questions.select("query_id", "question").join(models.context_blocks(p), "query_id", "left")
    asked = x.filter("context is not null").withColumn("answer", _ask(F.concat(F.lit("Use the sources.\n\n"), "context", F.lit("\n\nQuestion: "), "question"), factory))
    out = asked.unionByName(x.filter("context is null").withColumn("answer", F.lit(NO_CONTEXT)))
    known = F.transform(F.regexp_extract_all(F.coalesce("context", F.lit("")), F.lit(r"(?m)^\[(S\d+)\] Source:"), F.lit(1)), lambda v: v)
    cited = F.coalesce(T.citations(F.col("answer")), F.array().cast("array<string>"))
    return out.withColumn("known", known).withColumn("cited", F.when(F.size(cited) > 0, F.array_intersect(cited, F.col("known"))).otherwise(F.col("known"))).withColumn("invalid", F.array_except(cited, F.col("known"))).drop("known")


def checked(answered: DataFrame, factory: Factory, fail_open: bool = False) -> DataFrame:
    """Adds grounded: what the judge's JSON says; an unreadable reply counts as fail_open
    says, and an answer without context is never grounded."""
    j = models.json_object(_ask(F.concat(F.lit("Is the answer grounded? JSON {\"grounded\": bool}\n"), F.coalesce("context", F.lit("")), F.lit("\n\n"), "answer"), factory), "grounded boolean")
    return answered.withColumn("grounded", F.when(F.col("context").isNull(), False).otherwise(F.coalesce(j["grounded"], F.lit(fail_open))))


def compressed(hits: DataFrame, factory: Factory) -> DataFrame:
    """Passages (query_id, id, question, text) reduced to what matters for the question;
    those the model answers NONE for are dropped, those without a reply stay whole."""
    r = cut(hits.withColumn("reply", _ask(F.concat(F.lit("Keep what answers:\n"), "question", F.lit("\n\n"), "text"), factory)))
    return r.withColumn("text", F.coalesce("reply", "text")).filter("upper(trim(text)) <> 'NONE'").drop("reply")


def agentic(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], rewrite: Factory, max_retries: int = 2) -> DataFrame:
    """(query_id, id, rank, round): questions without a hit are rewritten and tried again,
    at most max_retries times; every question keeps its own text for the answer."""

    def attempt(now: DataFrame, i: int):
        got = cut(retrieve(now).withColumn("round", F.lit(i)))
        left = now.join(got.select("query_id").distinct(), "query_id", "left_anti")
        again = cut(left.withColumn("question", F.coalesce(_ask(F.concat(F.lit("Rewrite:\n"), "question"), rewrite), "question")))
        return got, again

    return models.retried(questions.select("query_id", "question"), attempt, max_retries)


def enhanced(chunks: DataFrame, factory: Factory) -> DataFrame:
    """Chunks (key, chunk) with characters, locations, time_period, topic and sentiment as
    the model's JSON gives them, capitalised names as characters where it gives none."""
    schema = "characters array<string>, locations array<string>, time_period string, topic string, sentiment string"
    j = cut(chunks.withColumn("m", models.json_object(_ask(F.concat(F.lit("Metadata as JSON:\n"), "chunk"), factory), schema)))
    names = F.regexp_extract_all("chunk", F.lit(r"\p{Lu}[\p{L}'’]+(?: \p{Lu}[\p{L}'’]+){1,3}"), F.lit(0))
    none = F.array().cast("array<string>")
    return j.select("key", "chunk", F.coalesce("m.characters", F.sort_array(F.array_distinct(names))).alias("characters"), F.coalesce("m.locations", none).alias("locations"), "m.time_period", "m.topic", "m.sentiment")


# ------------------------------------------------------------------ questions


def rewritten(questions: DataFrame, factory: Factory, mode: str = "auto") -> DataFrame:
    """Questions (query_id, question) with asked, the text as it was: rewritten for the
    search always, never, or (auto) only where they have no accents; a missing reply
    leaves the question."""
    if mode not in ("auto", "always", "never"):
        raise ValueError(f"unknown mode: {mode}")
    x = questions.withColumn("asked", F.col("question"))
    if mode == "never":
        return x
    gate = F.lit(True) if mode == "always" else ~T.has_diacritics(F.col("question"))
    open_ = x.filter(F.coalesce(gate, F.lit(False))).withColumn("question", F.coalesce(_ask(F.concat(F.lit("Rewrite for a search:\n"), "question"), factory), "question"))
    return open_.unionByName(x.filter(~F.coalesce(gate, F.lit(False))))


def model_variations(questions: DataFrame, factory: Factory, n: int = 3) -> DataFrame:
    """(query_id, variation_no, query): the question and up to n lines of a reply that are
    not the question; templates where no reply comes."""
    x = cut(questions.withColumn("ls", models.lines(_ask(F.concat(F.lit("Other wordings, one a line:\n"), "question"), factory))))
    x = x.withColumn("ls", F.slice(F.filter("ls", lambda v: v != F.trim("question")), 1, n))
    own = x.filter(F.size("ls") > 0).select("query_id", F.posexplode(F.concat(F.array("question"), "ls")).alias("variation_no", "query"))
    return own.unionByName(fusion.variations(x.filter(F.size("ls") == 0), "query_id", "question", n))


def hype_index(chunks: DataFrame, factory: Factory, n: int = 3, head: int = 1000) -> DataFrame:
    """(prompt_id, id, prompt): up to n questions that each chunk (id, text) could answer."""
    ls = F.slice(models.lines(_ask(F.concat(F.lit("Questions this answers, one a line:\n"), F.substring("text", 1, head)), factory)), 1, n)
    x = cut(chunks.select("id", F.posexplode(ls).alias("pos", "prompt")))
    return x.select(F.xxhash64("id", "pos").alias("prompt_id"), "id", "prompt")


def hype_search(questions: DataFrame, index: DataFrame, k: int, pool: int = 20) -> DataFrame:
    """(query_id, id, rank): chunks by their question nearest to each question, every
    chunk once."""
    near = vector.top_k(vector.hash_embeddings(questions, "query_id", "question"), vector.hash_embeddings(index, "prompt_id", "prompt"), pool * k, "id", "id")
    best = near.join(index.select(F.col("prompt_id").alias("id"), F.col("id").alias("chunk")), "id").groupBy("query_id", "chunk").agg(F.min("rank").alias("best"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "chunk"))).filter(F.col("rank") <= k).select("query_id", F.col("chunk").alias("id"), "rank")


def first_that_finds(questions: DataFrame, strategies: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Hits of the first strategy that finds any for a question: the later ones are asked
    only about the questions without a hit."""
    out, left = None, questions
    for s in strategies:
        hits = cut(s(left))
        out = hits if out is None else out.unionByName(hits, allowMissingColumns=True)
        left = left.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    return out


def poor(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """The questions without a passage left after grading: those that need a fallback."""
    return questions.join(hits.select("query_id").distinct(), "query_id", "left_anti")


def self_checked(answered: DataFrame, hits: DataFrame, corpus: DataFrame, factory: Factory, critic: Factory, max_rounds: int = 2) -> DataFrame:
    """(query_id, answer, grounded, round): answers that the critic does not find grounded
    are asked again, at most max_rounds times; the last answer of a question counts."""

    def attempt(now: DataFrame, i: int):
        got = cut(checked(answers(now.select("query_id", "question"), hits, corpus, factory), critic).withColumn("round", F.lit(i)))
        again = now.join(got.filter("not grounded and context is not null").select("query_id"), "query_id", "left_semi")
        return got.select("query_id", "answer", "grounded", "round"), again

    every = models.retried(answered.select("query_id", "question"), attempt, max_rounds)
    w = Window.partitionBy("query_id").orderBy(F.desc("round"))
    return every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
