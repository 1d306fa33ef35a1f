"""Queries over texts and chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from taleweave.functions import text as T
from taleweave.operators import chunking, stories
from taleweave.operators.sequence import neighbours
from taleweave.plans import dialect
from taleweave.session import load
from taleweave.sources import loaders

_FOLD, _STRIP, _NORMAL, _KEY = dialect.FOLD, dialect.STRIP, dialect.NORMAL, dialect.KEY
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return load(spark, d, "documents")


@query(f"select doc_id, md5({_NORMAL.format('text')}) as normal_md5 from documents")
def text_normalize(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.normal(F.col("text"))).alias("normal_md5"))


@query(f"select doc_id, md5({_FOLD.format('text')}) as folded_md5, {_FOLD.format('text')} <> replace(lower(text), 'ß', 'ss') as accented from documents")
def fold_diacritics(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded_md5"), T.has_diacritics(F.col("text")).alias("accented"))


@query(f"select doc_id, {_KEY.format('title')} as title_key from documents")
def match_keys(spark, d):
    return _docs(spark, d).select("doc_id", T.match_key(F.col("title")).alias("title_key"))


@query(f"""
with c as (select doc_id, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) n, length(regexp_replace(lower(text), '[^{T.VIETNAMESE_LETTERS}]', '', 'g')) v from documents)
select doc_id, case when coalesce(n, 0) = 0 then 'unknown' when v / n > 0.05 then 'vi' when v / n > 0.01 then 'mixed' else 'en' end as language from c
""")
def detect_language(spark, d):
    return _docs(spark, d).select("doc_id", T.language_by_letters(F.col("text")).alias("language"))


@query("""
with a as (select record_id, regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g') x from fairy_tales)
select record_id, md5(regexp_replace(regexp_replace(x, '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\p{Z}]+$', '', 'g')) as cleaned_md5 from a
""")
def clean_text(spark, d):
    return load(spark, d, "fairy_tales").select("record_id", F.md5(T.cleaned(F.col("text"))).alias("cleaned_md5"))


@query("select record_id, coalesce(regexp_extract(metadata['filename'], '([^/\\\\]+?)(\\.[^./\\\\]*)?$', 1), '') as stem from fairy_tales")
def source_keys(spark, d):
    return load(spark, d, "fairy_tales").select("record_id", T.source_key(F.element_at("metadata", "filename")).alias("stem"))


@query("select doc_id, case when length(text) > 240 then rtrim(substr(text, 1, 239)) || '...' else text end as excerpt from documents")
def excerpts(spark, d):
    return _docs(spark, d).select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("""
with e as (select doc_id, lang, cast(ceil(length(text) / case lang when 'en' then 4.0 when 'vi' then 3.0 when 'zh' then 1.5 else 3.5 end) as bigint) n from documents)
select doc_id, n as tokens, n > 512 as overflows, round(n / 512, 6) as used, n / 512 >= 0.8 as warn from e
""")
def context_budget(spark, d):
    n = T.estimated_tokens(F.col("text"), F.col("lang"))
    used = F.col("tokens") / 512
    return _docs(spark, d).select("doc_id", n.cast("long").alias("tokens")).select("doc_id", "tokens", (F.col("tokens") > 512).alias("overflows"), F.round(used, 6).alias("used"), (used >= 0.8).alias("warn"))


@query("select doc_id, md5(case when length(text) > 425 then right(text, 425) else text end) as tail_md5 from documents")
def truncate_tail(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.truncated_tail(F.col("text"), 128)).alias("tail_md5"))


@query("select md5(text) as text_md5, count(*) as n, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1")
def exact_duplicates(spark, d):
    g = _docs(spark, d).filter("text is not null").groupBy(F.md5("text").alias("text_md5"))
    return g.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


_NAMES = "list_distinct(list_filter(regexp_extract_all(text, '\\p{Lu}[\\p{L}''’]+(?: \\p{Lu}[\\p{L}''’]+){0,3}'), lambda x: length(x) > 1))"


@query(f"select doc_id, len({_NAMES}) as n_names, array_to_string(list_sort({_NAMES}), '|') as names from documents where text is not null")
def capitalised_names(spark, d):
    x = _docs(spark, d).filter("text is not null").select("doc_id", stories.capitalised_names(F.col("text")).alias("a"))
    return x.select("doc_id", F.size("a").alias("n_names"), F.array_join(F.sort_array("a"), "|").alias("names"))


@query("""
with s as (select doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)) p from documents where text is not null)
select doc_id, len(p) as n_sentences, list_max(list_transform(p, lambda x: length(x))) as longest, len(list_filter(p, lambda x: length(x) > 200)) as n_long from s
""")
def sentence_split(spark, d):
    x = _docs(spark, d).filter("text is not null").select("doc_id", F.split(F.regexp_replace("text", r"([.!?])[ \t\n\r]+", "$1\u0001"), "\u0001").alias("p"))
    return x.select("doc_id", F.size("p").alias("n_sentences"), F.array_max(F.transform("p", lambda v: F.length(v))).alias("longest"), F.size(F.filter("p", lambda v: F.length(v) > 200)).alias("n_long"))


_WINDOWS = """
w as (select doc_id, text, i from (select doc_id, text, unnest(range(0, cast(greatest(ceil((length(text) - 50) / 450.0), 1) as bigint))) i from documents where length(text) > 0)),
c as (select doc_id as key, cast(i as int) as chunk_index, cast(i * 450 as int) as start_index, substr(text, i * 450 + 1, 500) as chunk from w)
"""


def _windows(spark, d):
    return chunking.fixed_windows(_docs(spark, d), "doc_id", "text", 500, 50)


@query(f"with {_WINDOWS} select key, chunk_index, start_index, md5(chunk) as chunk_md5 from c")
def char_windows(spark, d):
    return _windows(spark, d).select("key", "chunk_index", "start_index", F.md5("chunk").alias("chunk_md5"))


@query(f"""with {_WINDOWS}, i as (select key, chunk_index, sha256(cast(key as varchar)) as document_id, sha256(chunk) as chunk_sha256 from c)
select key, chunk_index, document_id, chunk_sha256, sha256(document_id || ':' || chunk_index || ':' || chunk_sha256) as chunk_id from i""")
def chunk_ids(spark, d):
    x = chunking.stable_ids(_windows(spark, d), "key", ["start_index"], "chunk")
    return x.select("key", "chunk_index", "document_id", "chunk_sha256", "chunk_id")


@query("""
with t as (select doc_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') t from documents where text is not null),
w as (select doc_id, t, unnest(range(0, cast(greatest(ceil((len(t) - 10) / 90.0), 1) as bigint))) i from t where len(t) > 0)
select doc_id as key, cast(i as int) as chunk_index, md5(array_to_string(t[i * 90 + 1 : i * 90 + 100], ' ')) as chunk_md5 from w
""")
def token_windows(spark, d):
    x = chunking.token_windows(_docs(spark, d), "doc_id", "text", 100, 10)
    return x.select("key", "chunk_index", F.md5("chunk").alias("chunk_md5"))


@query("select doc_id, sha1(coalesce(source, '') || chr(10) || coalesce(title, '') || chr(10) || coalesce(substr(text, 1, 500), '')) as document_key from documents")
def document_key(spark, d):
    parts = [F.coalesce(c, F.lit("")) for c in (F.col("source"), F.col("title"), F.substring("text", 1, 500))]
    return _docs(spark, d).select("doc_id", F.sha1(F.concat_ws("\n", *parts)).alias("document_key"))


@query("""
with p as (select record_id, unnest(string_split_regex(text, '\\r?\\n[ \\t]*\\r?\\n')) x, generate_subscripts(string_split_regex(text, '\\r?\\n[ \\t]*\\r?\\n'), 1) i from fairy_tales where text is not null),
s as (select record_id, length(x) n, sum(case when regexp_matches(trim(x), '^(Phần|Hồi|Chapter|Part|Chapitre|Kapitel|Capítulo|Глава|第|บทที่|अध्याय) ?[0-9]*') and length(x) < 80 then 1 else 0 end) over (partition by record_id order by i) scene from p)
select record_id, cast(scene as bigint) as scene, count(*) as n_paragraphs, cast(sum(n) as bigint) as n_chars from s group by 1, 2
""")
def scene_split(spark, d):
    p = load(spark, d, "fairy_tales").filter("text is not null").select("record_id", F.posexplode(F.split("text", r"\r?\n[ \t]*\r?\n")).alias("i", "x"))
    head = F.trim("x").rlike("^(Phần|Hồi|Chapter|Part|Chapitre|Kapitel|Capítulo|Глава|第|บทที่|अध्याय) ?[0-9]*") & (F.length("x") < 80)
    s = p.withColumn("scene", F.sum(F.when(head, 1).otherwise(0)).over(Window.partitionBy("record_id").orderBy("i")))
    return s.groupBy("record_id", "scene").agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("x").cast("long")).alias("n_chars"))


@query("""
with n as (select document_key, chunk_row_id, row_number() over (partition by document_key order by chunk_index, chunk_row_id) - 1 i, count(*) over (partition by document_key) n from chunk_metadata)
select chunk_row_id, cast(least(i // 5, case when n % 5 >= 3 or n < 5 then cast(ceil(n / 5) as bigint) - 1 else greatest(n // 5, 1) - 1 end) as int) as group_no from n
""")
def raptor_sequential_groups(spark, d):
    c = load(spark, d, "chunk_metadata").select("document_key", "chunk_row_id", "chunk_index")
    x = neighbours(c, "document_key", ["chunk_index", "chunk_row_id"], F.floor(F.col("chunk_index") / 64), ["chunk_index"]).select("document_key", "chunk_row_id", (F.col("nth") - 1).alias("i"))
    return chunking.sequential_groups(x, "document_key", "i", 5).select("chunk_row_id", "group_no")


@query("""
select strategy, count(*) as n from (select case when length(text) < 500 then 'semantic' when len(regexp_extract_all(text, '\\n\\s*\\n')) > 5 then 'contextual' else 'default' end as strategy
from documents where text is not null) group by 1
""")
def adaptive_route(spark, d):
    return _docs(spark, d).filter("text is not null").select(chunking.routed(F.col("text")).alias("strategy")).groupBy("strategy").agg(F.count("*").alias("n"))


@query("""
select c_custkey as key, concat_ws(chr(10), case when trim(c_name) <> '' then 'c_name: ' || c_name end, 'c_nationkey: ' || c_nationkey, case when trim(c_mktsegment) <> '' then 'c_mktsegment: ' || c_mktsegment end) as text from customer
""")
def csv_row_documents(spark, d):
    return loaders.row_documents(load(spark, d, "customer"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


@query("select event_id, list_sort(json_keys(props))[1] as first_key, len(json_keys(props)) as n_keys from events")
def json_item_keys(spark, d):
    k = F.sort_array(F.json_object_keys("props"))
    return load(spark, d, "events").select("event_id", F.get(k, 0).alias("first_key"), F.size(k).cast("long").alias("n_keys"))


CATEGORIES = {"river": ["thuyền|bến|ferry|boat|barque|лодк|舟|船"], "craft": ["thợ|weaver|smith|forgeron|schmied|кузнец|铁匠"], "beast": ["cáo|fox|renard|fuchs|лиса|狐"]}


def _category_sql() -> str:
    hits = {k: f"len(regexp_extract_all(lower(text), '{v[0]}'))" for k, v in CATEGORIES.items()}
    best = f"greatest({', '.join(hits.values())})"
    return "case " + " ".join(f"when {h} = {best} and {best} > 0 then '{k}'" for k, h in hits.items()) + " else 'chung' end"


@query(f"select category, count(*) as n from (select {_category_sql()} as category from documents where text is not null) group by 1")
def classify_documents(spark, d):
    x = _docs(spark, d).filter("text is not null").select(stories.classify(F.col("text"), CATEGORIES).alias("category"))
    return x.groupBy("category").agg(F.count("*").alias("n"))


@query("""
with w as (select doc_id, text, string_split_regex(lower(text), '[ \\t\\r\\n]+') ws from documents where text is not null),
e as (select doc_id, unnest(ws) word from w), c as (select doc_id, word, count(*) n from e where length(word) > 3 group by 1, 2)
select doc_id, count(*) as n_repeated, max(n) as most from c where n > 3 group by 1
""")
def word_repeats(spark, d):
    e = _docs(spark, d).filter("text is not null").select("doc_id", F.explode(F.split(F.lower("text"), r"[ \t\r\n]+")).alias("word")).filter(F.length("word") > 3)
    return e.groupBy("doc_id", "word").agg(F.count("*").alias("n")).filter("n > 3").groupBy("doc_id").agg(F.count("*").alias("n_repeated"), F.max("n").alias("most"))


def _chunked(name: str, strategy: str, sql: str | None = None, **options):
    def run(spark, d):
        x = chunking.chunk(load(spark, d, "fairy_tales"), "record_id", "text", strategy, **options)
        return x.select("key", "chunk_index", F.md5("chunk").alias("chunk_md5"))

    run.__name__ = name
    query(sql)(run)


# white space as Python strips it, in patterns of the SQL side
_WS = r"[\s\x0b\x1c-\x1f\x85\xa0\p{{Z}}]"
_STRIPPED = "regexp_replace(regexp_replace({0}, '^" + _WS + "+', ''), '" + _WS + "+$', '')"
_WS = _WS.format()
_BOUNDARY = f"""
with recursive t as materialized (select record_id id, text, length(text) n from fairy_tales where length(text) > 0),
w as (select id, 0 i, 0 s, 0 e from t where false union all select id, 0, 0, case when n <= 1000 then n else coalesce(900 + nullif(length(regexp_extract(substr(text, 901, 100), '(?s)^.*[.!?\n]')), 0), 1000) end from t
  union all select id, i + 1, s2, case when s2 + 1000 >= n then n else coalesce(greatest(s2, s2 + 900) + nullif(length(regexp_extract(substr(text, s2 + 901, 100), '(?s)^.*[.!?\n]')), 0), s2 + 1000) end
  from (select w.id, w.i, t.text, t.n, greatest(w.e - 200, w.s + 1) s2 from w join t using (id) where w.e < t.n)),
p as (select id, i, {_STRIPPED.format("substr(text, s + 1, e - s)")} c from w join t using (id))
select id as key, cast(row_number() over (partition by id order by i) - 1 as int) as chunk_index, md5(c) as chunk_md5 from p where c <> ''
"""
_PARAGRAPHS = f"""
with recursive q as (select record_id id, {_STRIPPED.format("unnest(x)")} p, generate_subscripts(x, 1) k from (select record_id, string_split_regex(text, '\n{_WS}*\n') x from fairy_tales where text is not null)),
r as (select id, k, p, unnest(range(0, cast(ceil(length(p) / 4000.0) as bigint))) j, cast(ceil(length(p) / 4000.0) as bigint) m from q where p <> ''),
u as materialized (select id, substr(p, j * 4000 + 1, 4000) c, j < m - 1 hard, row_number() over (partition by id order by k, j) i from r),
g as (select id, i, 1 as grp, case when hard then 1000000 else length(c) end acc from u where i = 1
  union all select u.id, u.i, case when u.hard or g.acc + 2 + length(u.c) > 4000 then g.grp + 1 else g.grp end, case when u.hard then 1000000 when g.acc + 2 + length(u.c) > 4000 then length(u.c) else g.acc + 2 + length(u.c) end from g join u on u.id = g.id and u.i = g.i + 1)
select id as key, cast(grp - 1 as int) as chunk_index, md5(string_agg(c, chr(10) || chr(10) order by i)) as chunk_md5 from g join u using (id, i) group by 1, grp
"""
_SENTENCES = f"""
with recursive q as (select record_id id, unnest(x) p, generate_subscripts(x, 1) k from (select record_id, string_split(regexp_replace(text, '([.!?])({_WS})', '\\1' || chr(1) || '\\2', 'g'), chr(1)) x from fairy_tales where text is not null)),
s as materialized (select id, c, length(c) n, row_number() over (partition by id order by k) i from (select id, k, regexp_replace(regexp_replace(p, '^{_WS}+', ''), '\n$', '') c from q) where c <> ''),
a as materialized (select id, list_prepend(0, list(cum order by i)) cs, max(i) m from (select id, i, sum(n) over (partition by id order by i) cum from s) group by 1),
g as (select id, cast(1 as bigint) i, cast(1 as bigint) f, cast(null as bigint) done from a
  union all select g.id, g.i + 1, case when over_ then g.i + 1 - len(list_filter(cs[f : g.i], lambda x: cs[g.i + 1] - x <= 50))  else f end, case when over_ then f end
  from (select *, cs[g.i + 2] - cs[f] > 500 over_ from g join a using (id) where g.i < m) g),
e as (select id, done f, i - 1 l from g where done is not null union all select g.id, g.f, g.i from g join a on a.id = g.id and a.m = g.i),
o as (select e.id, e.f, e.l, string_agg(c, ' ' order by i) c from e join s on s.id = e.id and s.i between e.f and e.l group by 1, 2, 3)
select id as key, cast(row_number() over (partition by id order by l) - 1 as int) as chunk_index, md5(c) as chunk_md5 from o
"""
_chunked("recursive_chunks", "recursive", size=500, overlap=50)
_chunked("boundary_windows", "windows", _BOUNDARY, size=1000, overlap=200)
_chunked("paragraph_units", "paragraphs", _PARAGRAPHS, size=4000)
_chunked("sentence_packs", "sentences", _SENTENCES, size=500, overlap=50)


def _held(pieces, whole, size: int):
    """(key, within, in_place, covered): no piece above its size, each standing in the text
    where it says, and together all of its characters but white space."""
    x = pieces.join(whole, "key").withColumn("end", F.col("start_index") + F.length("chunk"))
    x = x.withColumn("ok", F.expr("substring(text, start_index + 1, length(chunk))") == F.col("chunk"))
    w = Window.partitionBy("key").orderBy("start_index", "chunk_index")
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("b", before).withColumn("gap", F.expr("substring(text, b + 1, greatest(start_index - b, 0))"))
    g = x.groupBy("key").agg(F.max(F.length("chunk")).alias("most"), F.every("ok").alias("in_place"), F.every(F.trim(F.regexp_replace("gap", r"(?U)[\s\p{Z}]+", "")) == "").alias("no_gap"), F.max("end").alias("end"))
    tail = F.trim(F.regexp_replace(F.expr("substring(text, end + 1)"), r"(?U)[\s\p{Z}]+", "")) == ""
    return g.join(whole, "key").select("key", (F.col("most") <= size).alias("within"), "in_place", (F.col("no_gap") & tail).alias("covered"))


@query(f"select record_id as key, true as within, true as in_place, true as covered from fairy_tales where {_STRIPPED.format('text')} <> ''")
def recursive_check(spark, d):
    """What holds of the recursive chunks of every text."""
    t = load(spark, d, "fairy_tales").filter("text is not null").select(F.col("record_id").alias("key"), "text")
    return _held(chunking.chunk(t, "key", "text", "recursive", size=500, overlap=50), t, 500)


@query(f"select record_id as key, true as within, true as in_place, true as covered, true as named from fairy_tales where {_STRIPPED.format('text')} <> ''")
def parent_child_check(spark, d):
    """What holds of parents and children: both cover what they are cut from, and every
    child has its parent."""
    t = load(spark, d, "fairy_tales").filter("text is not null").select(F.col("record_id").alias("key"), "text")
    parents, _ = chunking.parent_child(t, "key")
    parents = parents.dropDuplicates(["parent_id"])
    children = chunking.chunk(parents, "parent_id", "text", "recursive", size=250, overlap=25)
    c = _held(children, parents.select(F.col("parent_id").alias("key"), "text"), 250).withColumnRenamed("key", "parent_id")
    g = parents.join(c, "parent_id", "left").groupBy("key").agg(*[F.every(F.coalesce(x, F.lit(False))).alias(x) for x in ("within", "in_place", "covered")], F.every(F.length("parent_id") == 20).alias("named"))
    return g


@query()
def parent_child_chunks(spark, d):
    parents, children = chunking.parent_child(load(spark, d, "fairy_tales"), "record_id")
    return children.join(parents.select("parent_id", "key").distinct(), "parent_id").select("key", "parent_id", "child_index", F.length("text").alias("n_chars"))


@query("""
select doc_id, array_to_string(['S' || cast(least(doc_id % 5 + 1, doc_id % 12 + 1) as varchar)] || case when doc_id % 5 + 1 <> doc_id % 12 + 1 then ['S' || cast(greatest(doc_id % 5 + 1, doc_id % 12 + 1) as varchar)] else [] end, ',') as cited from documents
""")
def citations(spark, d):
    answer = F.concat(F.lit("see [S"), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("] and [S"), (F.col("doc_id") % 12 + 1).cast("string"), F.lit("] [S"), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("].")) 
    return _docs(spark, d).select("doc_id", F.array_join(T.citations(answer), ",").alias("cited"))


@query("select event_id, printf('%02d:%02d', cast(floor(epoch(ts)) as bigint) % 3600 // 60, cast(floor(epoch(ts)) as bigint) % 60) as clock from events")
def clock_format(spark, d):
    s = F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), F.lit(3600))
    return load(spark, d, "events").select("event_id", T.clock(s).alias("clock"))


@query()
def pattern_entities(spark, d):
    """Entities by patterns in the texts of all documents, with their positions."""
    from taleweave.functions import replies

    return replies.entities(_docs(spark, d), "doc_id", "text").withColumnRenamed("key", "doc_id")


@query("select doc_id, concat_ws(chr(10), case when title is not null then 'title: ' || title end, case when source is not null then 'source: ' || source end, case when lang is not null then 'lang: ' || lang end) as profile from documents")
def profiles(spark, d):
    """Label: value lines of the known fields."""
    return loaders.row_documents(_docs(spark, d), "doc_id", ["title", "source", "lang"]).select(F.col("key").alias("doc_id"), F.col("text").alias("profile"))


@query("select doc_id, regexp_replace(regexp_extract(source || '/' || coalesce(title, ''), '([^/\\\\]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g') as file_name from documents")
def safe_names(spark, d):
    return _docs(spark, d).select("doc_id", T.safe_name(F.concat("source", F.lit("/"), F.coalesce("title", F.lit("")))).alias("file_name"))
