"""What an entity graph gives to a search: profiles of entities, those a question names,
community reports, and the upkeep of the graph by document.

Graphs are rows (document_key, document_name, entities, relationships) as extracted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions import text as T
from taleweave.operators import graph
from taleweave.operators.incremental import delete
from taleweave.session import small_side

#: Relationships of a profile, entities and relationships of a report prompt.
PROFILE_RELATIONS, REPORT_ENTITIES, REPORT_RELATIONS = 8, 40, 60


def entities_of(graphs: DataFrame) -> DataFrame:
    """(document_key, document_name, key, name, type, description): one row per document
    and entity; the first name, the first type that is not other, the distinct
    descriptions joined by a space (empty if there is none)."""
    x = graphs.select("graph_id", "document_key", "document_name", F.explode("entities").alias("e")).select("graph_id", "document_key", "document_name", T.normal(F.col("e.name")).alias("key"), "e.name", F.nullif(F.lower(F.trim("e.type")), F.lit("")).alias("type"), F.trim("e.description").alias("d"))
    named = F.when(F.col("type") != "other", F.struct("graph_id", "type"))
    g = x.filter("key <> ''").groupBy("document_key", "key").agg(
        F.min(F.struct("graph_id", "name")).alias("n"), F.min(named).alias("t"), F.min("document_name").alias("document_name"), F.array_join(F.array_sort(F.collect_set(F.nullif("d", F.lit("")))), " ").alias("description")
    )
    return g.select("document_key", "document_name", "key", F.col("n.name").alias("name"), F.coalesce("t.type", F.lit("other")).alias("type"), "description")


def relations_of(graphs: DataFrame) -> DataFrame:
    """(document_key, document_name, u, v, n, description), u < v: one row per document and
    pair of entity keys, with its number of relations; relations to itself are left out."""
    x = graphs.select("document_key", "document_name", F.explode("relationships").alias("r")).select("document_key", "document_name", T.normal(F.col("r.source")).alias("a"), T.normal(F.col("r.target")).alias("b"), F.trim("r.description").alias("d"))
    x = x.filter("a <> '' and b <> '' and a <> b").select("document_key", "document_name", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "d")
    return x.groupBy("document_key", "u", "v").agg(F.min("document_name").alias("document_name"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.nullif("d", F.lit("")))), " ").alias("description"))


def merged(entities: DataFrame) -> DataFrame:
    """(key, name, type, documents) over all documents, the first by document key."""
    named = F.when(F.col("type") != "other", F.struct("document_key", "type"))
    g = entities.groupBy("key").agg(F.min(F.struct("document_key", "name")).alias("n"), F.min(named).alias("t"), F.countDistinct("document_key").alias("documents"))
    return g.select("key", F.col("n.name").alias("name"), F.coalesce("t.type", F.lit("other")).alias("type"), "documents")


def edges_of(relations: DataFrame) -> DataFrame:
    """(u, v, weight) over all documents."""
    return relations.groupBy("u", "v").agg(F.sum("n").alias("weight"))


def _labelled(several: Column) -> Column:
    return F.when(several, F.concat("document_name", F.lit(": "), "description")).otherwise(F.col("description"))


def profiles(entities: DataFrame, relations: DataFrame, allowed: DataFrame | None = None, most: int = PROFILE_RELATIONS) -> DataFrame:
    """(key, name, n_documents, content, profile): what the graph says about an entity. The
    content is its name, type and descriptions; the profile adds its heaviest described
    relations. An entity of several documents names the document of each line. allowed
    (document_key) limits all of it; entities outside it have no profile."""
    e, r = (x if allowed is None else x.join(small_side(allowed.select("document_key").distinct()), "document_key", "left_semi") for x in (entities, relations))
    view = merged(entities).drop("documents")
    counted = e.groupBy("key").agg(F.countDistinct("document_key").alias("n_documents"))
    lines = e.join(counted, "key").withColumn("line", F.when(F.col("description") != "", F.concat(F.lit("\n  "), _labelled(F.col("n_documents") > 1))).otherwise(""))
    said = lines.groupBy("key", "n_documents").agg(F.array_sort(F.collect_list(F.struct("document_key", "document_name", "line"))).alias("d"))
    head = F.concat("name", F.lit(" ("), "type", F.lit("; "), F.array_join(F.transform("d", lambda x: x["document_name"]), ", "), F.lit(")"))
    content = F.concat(head, F.array_join(F.transform("d", lambda x: x["line"]), ""))
    both = r.filter("description <> ''").select("document_key", "document_name", "description", F.col("u").alias("key"), F.col("v").alias("other")).unionByName(r.filter("description <> ''").select("document_key", "document_name", "description", F.col("v").alias("key"), F.col("u").alias("other")))
    told = both.join(counted, "key").groupBy("key", "other").agg(F.array_sort(F.collect_list(F.struct("document_key", _labelled(F.col("n_documents") > 1).alias("t")))).alias("ts"))
    weights = edges_of(relations)
    weights = weights.select(F.col("u").alias("key"), F.col("v").alias("other"), "weight").unionByName(weights.select(F.col("v").alias("key"), F.col("u").alias("other"), "weight"))
    named = told.join(weights, ["key", "other"]).join(view.select(F.col("key").alias("other"), F.col("name").alias("other_name")), "other")
    ranked = named.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "other_name", "other"))).filter(F.col("nth") <= most)
    related = ranked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "other_name", F.array_join(F.transform("ts", lambda x: x["t"]), " | ").alias("t")))).alias("rel"))
    out = said.join(view, "key").join(related, "key", "left")
    more = F.array_join(F.transform(F.coalesce("rel", F.array().cast("array<struct<nth:int,other_name:string,t:string>>")), lambda x: F.concat(F.lit("\n  - "), F.col("name"), F.lit(" — "), x["other_name"], F.lit(": "), x["t"])), "")
    return out.select("key", "name", "n_documents", content.alias("content"), F.concat(content, more).alias("profile"))


def folded_name(c: Column) -> Column:
    """ASCII words without accents, one space between them."""
    return F.array_join(T.folded_words(c), " ")


def named_in(questions: DataFrame, view: DataFrame, least: int = 3) -> DataFrame:
    """(query_id, key): entities whose folded name of at least `least` letters stands in a
    question (query_id, question) as whole words. The runs of words of a question, up to
    the longest name, meet the names by equality, so no pair is tried in vain."""
    names = view.select("key", folded_name(F.col("name")).alias("folded")).filter(F.length("folded") >= least)
    longest = names.agg(F.max(F.size(F.split("folded", " "))).alias("m")).first().m or 0
    words = questions.select("query_id", T.folded_words(F.col("question")).alias("w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(max(1, longest)), F.size("w") - i + 1)), lambda n: F.array_join(F.slice(F.col("w"), i, n), " "))))
    asked = words.filter(F.size("w") > 0).select("query_id", F.explode(F.array_distinct(runs)).alias("folded"))
    return asked.join(names, "folded").select("query_id", "key").distinct()


def candidates(named: DataFrame, close: DataFrame, k: int) -> DataFrame:
    """(query_id, key, rank): the entities a question may be about, at most k: those it
    names first, longer keys before shorter ones, then those close to it (query_id, key,
    rank); every entity once."""
    first = named.select("query_id", "key", F.lit(0).alias("by"), (-F.length("key")).alias("o"))
    then = close.select("query_id", "key", F.lit(1).alias("by"), F.col("rank").alias("o"))
    best = first.unionByName(then).groupBy("query_id", "key").agg(F.min(F.struct("by", "o")).alias("b"))
    w = Window.partitionBy("query_id").orderBy("b.by", "b.o", "key")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "key", "rank")


def reports(labels: DataFrame, entities: DataFrame, relations: DataFrame, min_size: int = 3) -> DataFrame:
    """(community, size, documents, prompt, report_id) of communities (node, community) of
    at least min_size entities: members by degree, at most REPORT_ENTITIES with what is
    said of them, then the heaviest relations inside. The id is that of the prompt, so an
    unchanged community keeps its report."""
    edges = edges_of(relations)
    large = graph.large_communities(labels, min_size).withColumnRenamed("node", "key")
    view = merged(entities).drop("documents")
    degree = graph.weighted_degree(edges).withColumnRenamed("node", "key")
    said = entities.groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("description") != "", F.struct("document_key", F.concat("document_name", F.lit(": "), "description").alias("t"))))), lambda x: x["t"]), " | ").alias("said"), F.collect_set("document_key").alias("docs")
    )
    members = large.join(view, "key").join(degree, "key", "left").join(said, "key", "left")
    nth = F.row_number().over(Window.partitionBy("community").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "key"))
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit(")"), F.when(F.col("said") != "", F.concat(F.lit(" — "), "said")).otherwise(""))
    listed = members.withColumn("i", nth).groupBy("community", "size").agg(
        F.array_sort(F.collect_list(F.when(F.col("i") <= REPORT_ENTITIES, F.struct("i", line.alias("l"))))).alias("es"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("documents")
    )
    told = relations.filter("description <> ''").groupBy("u", "v").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("document_key", F.concat("document_name", F.lit(": "), "description").alias("t")))), lambda x: x["t"]), " | ").alias("t"))
    a, b = (large.select(F.col("key").alias(x), F.col("community").alias(f"c{x}")) for x in "uv")
    va, vb = (view.select(F.col("key").alias(x), F.col("name").alias(f"n{x}")) for x in "uv")
    inside = edges.join(a, "u").join(b, "v").filter("cu = cv").join(told, ["u", "v"], "left").join(va, "u").join(vb, "v")
    j = F.row_number().over(Window.partitionBy("cu").orderBy(F.desc("weight"), "u", "v"))
    rel = inside.withColumn("j", j).filter(F.col("j") <= REPORT_RELATIONS).groupBy(F.col("cu").alias("community")).agg(F.array_sort(F.collect_list(F.struct("j", F.concat(F.lit("- "), "nu", F.lit(" — "), "nv", F.lit(": "), F.coalesce("t", F.lit(""))).alias("l")))).alias("rs"))
    lines = lambda c: F.array_join(F.transform(c, lambda x: x["l"]), "\n")
    names = entities.groupBy("document_key").agg(F.min("document_name").alias("document_name"))
    titles = listed.select("community", F.explode("documents").alias("document_key")).join(names, "document_key").groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("document_key", "document_name"))), lambda x: x["document_name"]), ", ").alias("titles"))
    x = listed.join(rel, "community", "left").join(titles, "community", "left")
    prompt = F.concat(F.lit("Report on what links these.\nDocuments: "), F.coalesce("titles", F.lit("")), F.lit("\nEntities:\n"), lines(F.col("es")), F.lit("\nRelationships:\n"), F.coalesce(lines(F.col("rs")), F.lit("-")))
    return x.select("community", "size", "documents", prompt.alias("prompt")).withColumn("report_id", F.substring(F.sha1(F.concat(F.lit("graph-community|"), "prompt")), 1, 20))


def qualifying_reports(reports_: DataFrame, allowed: DataFrame) -> DataFrame:
    """Reports all documents of which are allowed (document_key): a report mixes its
    documents, so one that is not allowed forbids it. A report without documents passes."""
    each = reports_.select("community", F.explode("documents").alias("document_key"))
    bad = each.join(small_side(allowed.select("document_key").distinct()), "document_key", "left_anti").select("community").distinct()
    return reports_.join(bad, "community", "left_anti")


def relationships(graphs: DataFrame, names: DataFrame) -> DataFrame:
    """(key, source, target, description): the relations of entities (key) at either end."""
    x = graphs.select(F.explode("relationships").alias("r")).select("r.source", "r.target", "r.description").withColumn("a", T.normal(F.col("source"))).withColumn("b", T.normal(F.col("target")))
    ends = x.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("key"), "source", "target", "description")
    return ends.join(small_side(names.select("key").distinct()), "key", "left_semi").distinct()


def subgraph(named: DataFrame, relations: DataFrame, max_hops: int = 2) -> DataFrame:
    """(query_id, u, v): the edges within max_hops of the entities a question names
    (query_id, key), as one walks outward from them. A negative number raises."""
    if not isinstance(max_hops, int) or isinstance(max_hops, bool) or max_hops < 0:
        raise ValueError("max_hops must be a whole number of 0 or more")
    edges = edges_of(relations).select("u", "v")
    near = named.select("query_id", F.col("key").alias("node"))
    if max_hops > 1:
        around = graph.hops(edges.withColumn("weight", F.lit(1)), named.select(F.col("key").alias("node")).distinct(), max_hops - 1)
        near = near.unionByName(named.join(around, named.key == around.start).select("query_id", "node")).distinct()
    if max_hops == 0:
        return near.select("query_id", F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    out = near.join(edges, near.node == edges.u).select("query_id", "u", "v").unionByName(near.join(edges, near.node == edges.v).select("query_id", "u", "v"))
    return out.distinct()


def applied(graphs: DataFrame, new: DataFrame, dropped: Column | None = None) -> DataFrame:
    """The graphs after an update: without those the predicate drops, and with the new
    ones in the place of those of the same document."""
    left = graphs if dropped is None else delete(graphs, dropped)
    return left.join(new.select("document_key").distinct(), "document_key", "left_anti").unionByName(new, allowMissingColumns=True)
