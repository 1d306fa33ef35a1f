"""Queries of entity graphs and of cross-story search, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleweave.functions import text as T
from taleweave.operators import graph, graphcontext, stories
from taleweave.plans import dialect
from taleweave.session import load
from taleweave.sources import sinks

QUERIES, SQL = {}, {}
_FOLD, _KEY, _NAME = dialect.FOLD, dialect.KEY, dialect.NORMAL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _entities(spark, d):
    """(key, name, type, document_key, graph_id)"""
    g = load(spark, d, "document_graphs").select("graph_id", "document_key", F.explode("entities").alias("e"))
    kind = F.nullif(F.lower(F.trim("e.type")), F.lit(""))
    return g.select(T.normal(F.col("e.name")).alias("key"), F.col("e.name").alias("name"), kind.alias("type"), "document_key", "graph_id").filter("key <> ''")


_E = f"e as (select {_NAME.format('x.name')} as key, x.name as name, nullif(lower(trim(x.type)), '') as type, document_key, graph_id from (select graph_id, document_key, unnest(entities) x from document_graphs)), k as (select * from e where key <> '')"


@query(f"""
with {_E} select key, arg_min(name, (graph_id, name)) as name, coalesce(arg_min(type, (graph_id, type)) filter (where type is not null and type <> 'other'), 'other') as type, count(distinct document_key) as n_documents from k group by 1
""")
def graph_merge(spark, d):
    named = F.when(F.col("type").isNotNull() & (F.col("type") != "other"), F.struct("graph_id", "type"))
    return _entities(spark, d).groupBy("key").agg(F.min(F.struct("graph_id", "name")).alias("n"), F.min(named).alias("t"), F.countDistinct("document_key").alias("n_documents")).select(
        "key", F.col("n.name").alias("name"), F.coalesce("t.type", F.lit("other")).alias("type"), "n_documents"
    )


_R = f"""r as (select {_NAME.format('x.source')} as a, {_NAME.format('x.target')} as b from (select unnest(relationships) x from document_graphs)),
edges as materialized (select least(a, b) u, greatest(a, b) v, count(*) weight from r where a is not null and b is not null and a <> b and a <> '' and b <> '' group by 1, 2)"""


def _edges(spark, d):
    r = load(spark, d, "document_graphs").select(F.explode("relationships").alias("x"))
    r = r.select(T.normal(F.col("x.source")).alias("source"), T.normal(F.col("x.target")).alias("target")).filter("source <> '' and target <> ''")
    return graph.undirected(r)


@query(f"with {_R} select u, v, weight from edges")
def graph_edges(spark, d):
    return _edges(spark, d)


_DEGREE = "dg as (select node, cast(sum(weight) as bigint) degree from (select u node, weight from edges union all select v, weight from edges) group by 1)"


@query(f"with {_R}, {_DEGREE} select node, degree from dg")
def graph_degree(spark, d):
    return graph.weighted_degree(_edges(spark, d))


_BOTH = "both_ as materialized (select u, v from edges union select v, u from edges)"
_STARTS = "st as (select node from dg order by degree desc, node limit 3)"


def _starts(spark, d, n=3):
    return graph.weighted_degree(_edges(spark, d)).orderBy(F.desc("degree"), "node").limit(n)


@query(f"""with recursive {_R}, {_DEGREE}, {_BOTH}, {_STARTS},
h as (select node as start, node, 0 as hops from st union select h.start, b.v, h.hops + 1 from h join both_ b on b.u = h.node where h.hops < 2)
select start, node, cast(min(hops) as int) as hops from h group by 1, 2 having min(hops) > 0""")
def graph_neighbors(spark, d):
    """Nodes within two edges of the three nodes of the highest degree."""
    return graph.hops(_edges(spark, d), _starts(spark, d), 2)


@query(f"""with recursive {_R}, {_DEGREE}, {_BOTH}, st as (select node, row_number() over (order by degree desc, node) i from dg qualify i <= 6), pr as (select x.node a, y.node b from st x, st y where x.i = 1),
w as (select a, b, a node, 0 as n from pr union select a, b, t.v, n + 1 from w join both_ t on t.u = w.node where n < 3)
select a, b, cast(min(n) as int) as length from w where node = b group by 1, 2""")
def graph_paths(spark, d):
    """Lengths of the shortest paths of at most three edges between the six nodes of the
    highest degree, from the first."""
    s = _starts(spark, d, 6)
    first = s.orderBy(F.desc("degree"), "node").limit(1).select(F.col("node").alias("a"))
    pairs = s.select(F.col("node").alias("b")).join(F.broadcast(first))  # six rows, one row
    return graph.shortest_paths(_edges(spark, d), pairs, 3).select("a", "b", "length")


@query(f"""with recursive {_R}, {_BOTH}, c as (select u as id, u as component from both_ union select b.v, c.component from c join both_ b on b.u = c.id)
select id, min(component) as component from c group by 1""")
def graph_components(spark, d):
    return graph.components(_edges(spark, d).select(F.col("u").alias("src"), F.col("v").alias("dst")))


_COMPONENTS = "c as (select u as id, u as component from both_ union select b.v, c.component from c join both_ b on b.u = c.id), cc as (select id, min(component) component from c group by 1)"


@query(f"""with recursive {_R}, {_BOTH}, {_COMPONENTS}
select count(*) as n_nodes, true as inside_components, true as better_than_single from cc""")
def graph_communities(spark, d):
    """What holds of the communities: they cover all nodes, none spans two components,
    their modularity is above that of single nodes."""
    edges = _edges(spark, d)
    labels = graph.communities(edges, rounds=3, levels=1)
    whole = graph.components(edges.select(F.col("u").alias("src"), F.col("v").alias("dst"))).select(F.col("id").alias("node"), F.col("component").alias("whole"))
    better = graph.modularity(edges, labels) > graph.modularity(edges, labels.withColumn("community", F.col("node")))
    spans = labels.join(whole, "node").groupBy("community").agg(F.countDistinct("whole").alias("k")).agg(F.max("k").alias("most"))
    return labels.agg(F.count("*").alias("n_nodes")).join(spans).select("n_nodes", (F.col("most") == 1).alias("inside_components"), F.lit(better).alias("better_than_single"))  # one row each


@query("""
select document_key, cast(count(*) as bigint) as n_graphs, max(graph_id) as latest_graph from document_graphs group by 1
""")
def graph_rebuilds(spark, d):
    return load(spark, d, "document_graphs").groupBy("document_key").agg(F.count("*").alias("n_graphs"), F.max("graph_id").alias("latest_graph"))


@query("""
with e as (select document_key, list_sort(list(distinct {'name': x.name, 'type': x.type})) entities from (select document_key, unnest(entities) x from document_graphs) group by 1),
r as (select document_key, list_sort(list(distinct {'source': x.source, 'target': x.target})) relationships from (select document_key, unnest(relationships) x from document_graphs) group by 1)
select document_key, len(entities) as n_entities, coalesce(len(relationships), 0) as n_relationships, entities[1].name as first_entity, entities[-1].name as last_entity from e full join r using (document_key)
""")
def graph_export(spark, d):
    """The exported JSON, read again."""
    g = load(spark, d, "document_graphs")
    e = g.select("document_key", F.explode("entities").alias("x")).select("document_key", "x.name", "x.type")
    r = g.select("document_key", F.explode("relationships").alias("x")).select("document_key", "x.source", "x.target")
    j = F.from_json("graph", "entities array<struct<name:string,type:string>>, relationships array<struct<source:string,target:string>>")
    names = F.transform("j.entities", lambda v: v["name"])
    return sinks.graph_export(e, r).select("document_key", j.alias("j")).select("document_key", F.size("j.entities").cast("long").alias("n_entities"), F.coalesce(F.size("j.relationships"), F.lit(0)).cast("long").alias("n_relationships"), names[0].alias("first_entity"), F.get(names, F.size(names) - 1).alias("last_entity"))


# graph context

_DE = f"""ge as (select graph_id, document_key, document_name, unnest(entities) x from document_graphs),
de as materialized (select document_key, key, arg_min(name, (graph_id, name)) name, coalesce(arg_min(type, (graph_id, type)) filter (where type <> 'other'), 'other') type, min(document_name) document_name, coalesce(string_agg(distinct nullif(trim(d), ''), ' ' order by nullif(trim(d), '')), '') description
  from (select graph_id, document_key, document_name, {_NAME.format('x.name')} key, x.name name, nullif(lower(trim(x.type)), '') type, x.description d from ge) where key <> '' group by 1, 2),
dr as materialized (select document_key, u, v, min(document_name) document_name, count(*) n, coalesce(string_agg(distinct nullif(trim(d), ''), ' ' order by nullif(trim(d), '')), '') description from (select document_key, document_name, least(a, b) u, greatest(a, b) v, d
  from (select document_key, document_name, {_NAME.format('x.source')} a, {_NAME.format('x.target')} b, x.description d from (select document_key, document_name, unnest(relationships) x from document_graphs)) where a <> '' and b <> '' and a <> b) group by 1, 2, 3),
vw as materialized (select key, arg_min(name, (document_key, name)) name, coalesce(arg_min(type, (document_key, type)) filter (where type <> 'other'), 'other') type from de group by 1)"""


def _parts(spark, d):
    g = load(spark, d, "document_graphs")
    return graphcontext.entities_of(g), graphcontext.relations_of(g)


@query(f"with {_DE} select document_key, key, name, type, description from de")
def graph_document_entities(spark, d):
    return _parts(spark, d)[0].drop("document_name")


@query(f"with {_DE} select document_key, u, v, n, description from dr")
def graph_document_relations(spark, d):
    return _parts(spark, d)[1].drop("document_name")


_PROFILES = """, al as (select distinct document_key from document_graphs {where}), ae as (select de.* from de join al using (document_key)), ar as (select dr.* from dr join al using (document_key)),
cn as (select key, count(distinct document_key) n from ae group by 1),
sd as (select key, n, string_agg(document_name, ', ' order by document_key, document_name) docs, string_agg(case when description <> '' then chr(10) || '  ' || case when n > 1 then document_name || ': ' || description else description end else '' end, '' order by document_key, document_name) lines from ae join cn using (key) group by 1, 2),
bt as (select document_key, document_name, description, u key, v other from ar where description <> '' union all select document_key, document_name, description, v, u from ar where description <> ''),
tl as (select key, other, string_agg(t, ' | ' order by document_key, t) t from (select *, case when n > 1 then document_name || ': ' || description else description end t from bt join cn using (key)) group by 1, 2),
wt as (select u, v, sum(n) w from dr group by 1, 2), w2 as (select u key, v other, w from wt union all select v, u, w from wt),
rk as (select tl.key, tl.t, o.name, row_number() over (partition by tl.key order by w desc, o.name, o.key) nth from tl join w2 using (key, other) join vw o on o.key = tl.other),
rl as (select rk.key, string_agg(chr(10) || '  - ' || vw.name || ' — ' || rk.name || ': ' || t, '' order by nth) rel from rk join vw on vw.key = rk.key where nth <= 8 group by 1),
pf as (select sd.key, vw.name, n n_documents, vw.name || ' (' || vw.type || '; ' || docs || ')' || lines as content, coalesce(rel, '') rel from sd join vw using (key) left join rl using (key))"""


@query(f"with {_DE}{_PROFILES.format(where='')} select key, name, n_documents, content, content || rel as profile from pf")
def graph_profiles(spark, d):
    return graphcontext.profiles(*_parts(spark, d))


_EVEN = "where extractor is not null"


@query(f"with {_DE}{_PROFILES.format(where=_EVEN)} select key, name, n_documents, content, content || rel as profile from pf")
def graph_profiles_filtered(spark, d):
    """Only what the documents of a known extractor say."""
    return graphcontext.profiles(*_parts(spark, d), allowed=load(spark, d, "document_graphs").filter("extractor is not null").select("document_key"))


_FOLDED_WORDS = f"array_to_string(regexp_extract_all({_FOLD}, '[a-z0-9]+'), ' ')"
_NAMED = f"""nm as (select key, {_FOLDED_WORDS.format('name')} f from vw), qs as (select doc_id query_id, ' ' || {_FOLDED_WORDS.format('title')} || ' ' q from documents where doc_id % 100 = 0 and title is not null),
hit as materialized (select query_id, key from qs join nm on length(f) >= 3 and contains(q, ' ' || f || ' '))"""


def _questions(spark, d):
    return load(spark, d, "documents").filter("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("question"))


@query(f"with {_DE}, {_NAMED} select query_id, key from hit")
def graph_named_in(spark, d):
    return graphcontext.named_in(_questions(spark, d), graphcontext.merged(_parts(spark, d)[0]))


@query(f"""with {_DE}, {_NAMED}, wq as (select doc_id query_id, list_distinct(regexp_extract_all({_FOLD.format('title')}, '[a-z0-9]+')) w from documents where doc_id % 100 = 0 and title is not null),
wn as (select key, list_distinct(string_split(f, ' ')) w from nm where f <> ''), sh as (select query_id, key, len(list_intersect(wq.w, wn.w)) s from wq join wn on len(list_intersect(wq.w, wn.w)) > 0),
cl as (select query_id, key, row_number() over (partition by query_id order by s desc, key) r from sh), u as (select query_id, key, 0 b, -length(key) o from hit union all select query_id, key, 1, r from cl where r <= 10),
m as (select query_id, key, min((b, o)) x from u group by 1, 2) select query_id, key, rank from (select query_id, key, row_number() over (partition by query_id order by x, key) rank from m) where rank <= 5""")
def graph_candidates(spark, d):
    """Five entities a title may be about: those it names, then those that share words."""
    view = graphcontext.merged(_parts(spark, d)[0])
    q = _questions(spark, d)
    a = q.select("query_id", F.explode(F.array_distinct(T.folded_words(F.col("question")))).alias("w"))
    b = view.select("key", F.explode(F.array_distinct(T.folded_words(F.col("name")))).alias("w"))
    shared = a.join(b, "w").groupBy("query_id", "key").agg(F.count("*").cast("double").alias("score"))
    from taleweave.operators import lexical

    close = lexical.top_k(shared, 10, key="key")
    return graphcontext.candidates(graphcontext.named_in(q, view), close, 5)


def _by_component(spark, d):
    """Communities of the reports' query: the components, which SQL can find."""
    e, r = _parts(spark, d)
    edges = graphcontext.edges_of(r)
    labels = graph.components(edges.select(F.col("u").alias("src"), F.col("v").alias("dst"))).select(F.col("id").alias("node"), F.col("component").alias("community"))
    return graphcontext.reports(labels, e, r)


_REPORTS = f"""{_DE}, wt as materialized (select u, v, sum(n) weight from dr group by 1, 2), both_ as materialized (select u, v from wt union select v, u from wt), {_COMPONENTS},
lg as (select component community, count(*) size from cc group by 1 having count(*) >= 3), mb as (select id key, community, size from cc join lg on lg.community = cc.component),
dg as (select key, sum(weight) degree from (select u key, weight from wt union all select v, weight from wt) group by 1),
sa as (select key, coalesce(string_agg(case when description <> '' then document_name || ': ' || description end, ' | ' order by document_key), '') said from de group by 1),
ml as (select community, size, key, '- ' || name || ' (' || type || ')' || case when said <> '' then ' — ' || said else '' end l, row_number() over (partition by community order by degree desc, key) i from mb join vw using (key) join dg using (key) join sa using (key)),
el as (select community, size, string_agg(l, chr(10) order by i) es from ml where i <= 40 group by 1, 2),
dl as (select community, list_sort(list(distinct document_key)) documents from mb join de using (key) group by 1), dn as (select document_key, min(document_name) dname from de group by 1),
dt as (select community, string_agg(dname, ', ' order by document_key) titles from (select community, unnest(documents) document_key from dl) join dn using (document_key) group by 1),
tl as (select u, v, string_agg(document_name || ': ' || description, ' | ' order by document_key) t from dr where description <> '' group by 1, 2),
rl as (select a.community, '- ' || x.name || ' — ' || y.name || ': ' || coalesce(t, '') l, row_number() over (partition by a.community order by weight desc, wt.u, wt.v) j from wt join mb a on a.key = wt.u join mb b on b.key = wt.v and a.community = b.community left join tl on tl.u = wt.u and tl.v = wt.v join vw x on x.key = wt.u join vw y on y.key = wt.v),
rs as (select community, string_agg(l, chr(10) order by j) rs from rl where j <= 60 group by 1),
rp as (select community, size, documents, 'Report on what links these.' || chr(10) || 'Documents: ' || titles || chr(10) || 'Entities:' || chr(10) || es || chr(10) || 'Relationships:' || chr(10) || coalesce(rs, '-') prompt from el join dl using (community) join dt using (community) left join rs using (community))"""


@query(f"with recursive {_REPORTS} select community, size, len(documents) as n_documents, substr(sha1('graph-community|' || prompt), 1, 20) as report_id from rp")
def graph_reports(spark, d):
    return _by_component(spark, d).select("community", "size", F.size("documents").cast("long").alias("n_documents"), "report_id")


@query(f"with recursive {_REPORTS}, ok as (select list(distinct document_key) a from document_graphs where extractor is not null) select community, size from rp, ok where len(list_filter(documents, lambda x: not list_contains(a, x))) = 0")
def graph_reports_filtered(spark, d):
    allowed = load(spark, d, "document_graphs").filter("extractor is not null").select("document_key")
    return graphcontext.qualifying_reports(_by_component(spark, d), allowed).select("community", "size")


@query(f"with {_DE}, {_NAMED}, k as (select distinct key from hit), r as (select {_NAME.format('x.source')} a, {_NAME.format('x.target')} b, x.source, x.target, x.description from (select unnest(relationships) x from document_graphs)) select distinct key, source, target, description from r join k on key = a or key = b")
def graph_relationships(spark, d):
    """Relations of the entities that some title names."""
    g = load(spark, d, "document_graphs")
    return graphcontext.relationships(g, graph_named_in(spark, d))


@query(f"""with {_DE}, {_NAMED}, e as (select u, v from dr group by 1, 2), b as (select u, v from e union select v, u from e), n1 as (select query_id, key node from hit union select query_id, b.v from hit join b on b.u = key)
select distinct query_id, u, v from n1 join e on node = u or node = v""")
def graph_subgraph(spark, d):
    return graphcontext.subgraph(graph_named_in(spark, d), _parts(spark, d)[1], 2)


@query("""select graph_id, document_key, extractor from document_graphs where not coalesce(extractor is null, false) and document_key not in (select document_key from document_graphs where graph_id % 3 = 0 and document_key is not null)
union all select graph_id + 1000000, document_key, 'again' from document_graphs where graph_id % 3 = 0""")
def graph_applied(spark, d):
    """Every third graph built anew, those without an extractor dropped."""
    g = load(spark, d, "document_graphs").select("graph_id", "document_key", "extractor")
    new = g.filter("graph_id % 3 = 0").select((F.col("graph_id") + 1000000).alias("graph_id"), "document_key", F.lit("again").alias("extractor"))
    return graphcontext.applied(g, new, F.col("extractor").isNull())


# stories

CATALOG = {"boat": ["thuyen", "boat", "barque", "barca"], "fox": ["cao trang", "fox", "renard", "zorro"], "bell": ["chuong", "bell", "cloche", "campana"], "bread": ["bread", "pain dur", "pan duro"]}


@query(f"""
with t as (select doc_id, {_KEY.format('text')} x from documents)
select doc_id, concat_ws(',', {", ".join(f"case when {' or '.join(f'''contains(x, '{k}')''' for k in ks)} then '{c}' end" for c, ks in sorted(CATALOG.items()))}) as labels from t
""")
def keyword_labels(spark, d):
    return load(spark, d, "documents").select("doc_id", F.coalesce(F.array_join(stories.labels(F.col("text"), CATALOG), ","), F.lit("")).alias("labels"))


_QUERY = "the fox and the iron key"
_SCORE = f"""
with s as (select story_row_id, title, {_KEY.format('text')} tk, coalesce({_KEY.format('title')}, '') kk from stories where text is not null), w as (select *, list_distinct(string_split(tk, ' ')) tw, list_distinct(string_split('{_QUERY}', ' ')) qw from s),
c as (select story_row_id, title, len(list_intersect(qw, tw)) + len(list_intersect(qw, tw)) / len(qw) + case when contains(tk, '{_QUERY}') then 1.0 else 0.0 end + case when contains(kk, '{_QUERY}') then 0.5 else 0.0 end score from w)
select story_row_id, round(score, 6) as score from c order by round(score, 6) desc, title, story_row_id limit 20
"""


@query(_SCORE)
def story_search(spark, d):
    s = load(spark, d, "stories").filter("text is not null").withColumn("tk", T.match_key(F.col("text"))).withColumn("kk", F.coalesce(T.match_key(F.col("title")), F.lit("")))
    score = stories.story_score(F.split(F.lit(_QUERY), " "), F.lit(_QUERY), F.array_distinct(F.split("tk", " ")), F.col("tk"), F.col("kk"))
    return s.select("story_row_id", "title", F.round(score, 6).alias("score")).orderBy(F.desc("score"), F.col("title").asc_nulls_last(), "story_row_id").limit(20).select("story_row_id", "score")


@query("""
with m as (select distinct story_id, trim(lower(x)) motif from (select story_id, unnest(motifs) x from stories) where trim(x) <> '')
select motif, count(*) as n_stories from m where story_id is not null group by 1
""")
def motif_rank(spark, d):
    """The stories of every motif."""
    m = load(spark, d, "stories").filter("story_id is not null").select("story_id", F.explode("motifs").alias("x")).select("story_id", F.lower(F.trim("x")).alias("motif")).filter("motif <> ''").distinct()
    return m.groupBy("motif").agg(F.count("*").alias("n_stories"))


@query("""
with s as (select tale_key, list_distinct(flatten(list(coalesce(motifs, [])))) m, list_distinct(flatten(list(coalesce(morals, [])))) l, list_distinct(flatten(list(coalesce(characters, [])))) c from stories where tale_key is not null group by 1)
select tale_key, len(list_filter(m, lambda x: x is not null)) as n_motifs, len(list_filter(l, lambda x: x is not null)) as n_morals, len(list_filter(c, lambda x: x is not null)) as n_characters from s
""")
def tale_profiles(spark, d):
    """Distinct labels of each tale: elements are made distinct before they meet, so a
    hot tale costs its distinct labels."""
    s = load(spark, d, "stories").filter("tale_key is not null")
    parts = None
    for kind in ("motifs", "morals", "characters"):
        x = s.select("tale_key", F.explode_outer(kind).alias("x")).select("tale_key", F.lit(kind).alias("kind"), "x").distinct()
        parts = x if parts is None else parts.unionByName(x)
    n = lambda k: F.count(F.when(F.col("kind") == k, F.col("x"))).alias(f"n_{k}")
    return parts.groupBy("tale_key").agg(n("motifs"), n("morals"), n("characters"))


def _compare_sql() -> str:
    side = lambda i: f"(select list_distinct(flatten(list(coalesce(motifs, [])))) m from stories where list_contains(characters, (select name from top where i = {i})))"
    return f"""
with n as (select trim(x) name, count(*) n from (select unnest(characters) x from stories) where trim(x) <> '' group by 1), top as (select name, row_number() over (order by n desc, name) i from n qualify i <= 2), a as {side(1)}, b as {side(2)}
select array_to_string(list_sort(list_filter(list_intersect(a.m, b.m), lambda x: x is not null)), ',') as shared, array_to_string(list_sort(list_filter(a.m, lambda x: x is not null and not list_contains(b.m, x))), ',') as only_a,
  array_to_string(list_sort(list_filter(b.m, lambda x: x is not null and not list_contains(a.m, x))), ',') as only_b from a, b
"""


@query(_compare_sql())
def compare_entities(spark, d):
    """Motifs of the stories of the two most frequent characters: shared, only the
    first's, only the second's."""
    s = load(spark, d, "stories")
    top = [r.name for r in s.select(F.explode("characters").alias("x")).select(F.trim("x").alias("name")).filter("name <> ''").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(2).collect()]
    name_a, name_b = [*top, "", ""][:2]

    def motifs(name):
        return F.collect_set(F.when(F.array_contains("characters", name), F.col("m")))

    x = s.select("characters", F.explode("motifs").alias("m")).agg(motifs(name_a).alias("a"), motifs(name_b).alias("b"))
    shared, only_a, only_b = stories.compare_sets(F.col("a"), F.col("b"))
    return x.select(F.array_join(shared, ",").alias("shared"), F.array_join(only_a, ",").alias("only_a"), F.array_join(only_b, ",").alias("only_b"))


@query(f"""with c as (select record_id, x, row_number() over () o from (select record_id, unnest(characters) x from fairy_tales where characters is not null) where x is not null),
k as (select record_id, {_KEY.format('x')} k, arg_min(x, o) x, min(o) o from c group by 1, 2), g as (select record_id, string_agg(x, '|' order by o) names from k group by 1)
select record_id, coalesce(names, '') as names from fairy_tales left join g using (record_id) where characters is not null""")
def distinct_characters(spark, d):
    x = load(spark, d, "fairy_tales").filter("characters is not null").withColumn("c", F.filter("characters", lambda v: v.isNotNull()))
    return stories.first_of_key(x, "c", "names").select("record_id", F.array_join("names", "|").alias("names"))


@query("select tradition, count(*) as n_tales, count(distinct d.doc_id) as n_documents from tale_catalog c left join documents d using (tale_key) group by 1")
def documents_by_tradition(spark, d):
    c = load(spark, d, "tale_catalog")
    return c.join(load(spark, d, "documents").select("tale_key", "doc_id"), "tale_key", "left").groupBy("tradition").agg(F.count("*").alias("n_tales"), F.countDistinct("doc_id").alias("n_documents"))


@query("select topic, sentiment, count(*) as n from (select coalesce(nullif(trim(lower(topic)), ''), 'none') as topic, coalesce(lower(trim(sentiment)), 'none') as sentiment from chunk_metadata) group by 1, 2")
def chunk_topics(spark, d):
    c = load(spark, d, "chunk_metadata").select(F.coalesce(F.nullif(F.trim(F.lower("topic")), F.lit("")), F.lit("none")).alias("topic"), F.coalesce(F.lower(F.trim("sentiment")), F.lit("none")).alias("sentiment"))
    return c.groupBy("topic", "sentiment").agg(F.count("*").alias("n"))
