"""Queries of incremental maintenance, serving and analytics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleweave.functions import text as T
from taleweave.operators import incremental, models, serving
from taleweave.plans import dialect
from taleweave.session import load

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


_SNAPSHOTS = """
o as (select 'doc/' || doc_id path, sha256(coalesce(text, '')) h from documents where doc_id % 7 <> 0),
n as (select 'doc/' || doc_id path, sha256(coalesce(case when doc_id % 11 = 0 then text || ' *' else text end, '')) h from documents where doc_id % 5 <> 0)
"""


def _snapshots(spark, d):
    docs = _docs(spark, d).withColumn("path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    old = incremental.manifest(docs.filter("doc_id % 7 <> 0"), "path", "text")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" *"))).otherwise(F.col("text")))
    return old, incremental.manifest(changed.filter("doc_id % 5 <> 0"), "path", "text")


@query(f"with {_SNAPSHOTS} select path, case when o.h is null then 'added' when n.h is null then 'removed' when o.h <> n.h then 'updated' else 'unchanged' end as status from o full join n using (path)")
def manifest_diff(spark, d):
    return incremental.manifest_diff(*_snapshots(spark, d))


@query("select 'doc/' || doc_id as path, sha256(coalesce(text, '')) as sha256, cast(strlen(coalesce(text, '')) as bigint) as size from documents")
def manifest(spark, d):
    return incremental.manifest(_docs(spark, d).withColumn("path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))), "path", "text")


@query("""
select doc_id, source, title from documents where doc_id % 3 <> 0 union all select doc_id, 'upload', title || ' *' from documents where doc_id % 3 = 0
""")
def upsert_by_id(spark, d):
    docs = _docs(spark, d).select("doc_id", "source", "title")
    return incremental.upsert(docs, docs.filter("doc_id % 3 = 0").select("doc_id", F.lit("upload").alias("source"), F.concat("title", F.lit(" *")).alias("title")), ["doc_id"])


@query("select doc_id, source, lang from documents where not coalesce(source = 'radio_tapes' and lang is null, false)")
def delete_by_filter(spark, d):
    return incremental.delete(_docs(spark, d).select("doc_id", "source", "lang"), incremental.matches({"source": "radio_tapes", "lang": None}))


@query("select doc_id from documents where lang in ('vi', 'ja') or lang is null")
def in_filter(spark, d):
    return _docs(spark, d).filter(incremental.matches({"lang": ["vi", "ja", None]})).select("doc_id")


@query("""
select coalesce(source, '') as source, count(*) as n_documents, cast(sum(greatest(ceil(length(text) / 500.0), 1)) as bigint) as n_chunks, cast(sum(length(text)) as bigint) as n_chars, count(title) as n_titled from documents where length(text) > 0 group by 1
""")
def list_documents(spark, d):
    x = _docs(spark, d).filter(F.length("text") > 0)
    n = F.greatest(F.ceil(F.length("text") / 500), F.lit(1))
    return x.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n_documents"), F.sum(n).cast("long").alias("n_chunks"), F.sum(F.length("text").cast("long")).alias("n_chars"), F.count("title").alias("n_titled"))


@query("""
select o_custkey, o_orderkey, row_number() over w as version, o_orderdate as valid_from, lead(o_orderdate) over w as valid_to, lead(o_orderdate) over w is null as is_current from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)
""")
def scd2_versions(spark, d):
    x = incremental.versions(load(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return x.select("o_custkey", "o_orderkey", "version", "valid_from", "valid_to", "is_current")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1")
def job_latest_status(spark, d):
    return incremental.latest(load(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("select story_id, story_row_id, title from (select *, row_number() over (partition by story_id order by ingested_at desc nulls last, story_row_id desc) r from stories) where r = 1")
def last_write_per_story(spark, d):
    return incremental.latest(load(spark, d, "stories"), ["story_id"], F.col("ingested_at").desc_nulls_last(), F.desc("story_row_id")).select("story_id", "story_row_id", "title")


_PROMPTS = "p as (select doc_id, sha256('summarise: ' || coalesce(title, '')) h from documents), a as (select distinct h, 'answer ' || substr(h, 1, 8) answer from p where doc_id % 4 <> 0)"


def _prompts(spark, d):
    p = _docs(spark, d).select("doc_id", F.concat(F.lit("summarise: "), F.coalesce("title", F.lit(""))).alias("prompt"))
    h = F.sha2("prompt", 256)
    return p, p.filter("doc_id % 4 <> 0").select(h.alias("prompt_sha256"), F.concat(F.lit("answer "), F.substring(h, 1, 8)).alias("answer")).distinct()


@query(f"with {_PROMPTS} select doc_id, answer from p left join a using (h)")
def prompt_replay(spark, d):
    return incremental.replayed(*_prompts(spark, d)).select("doc_id", "answer")


@query(f"with {_PROMPTS} select doc_id, h as prompt_sha256 from p where h not in (select h from a)")
def prompts_pending(spark, d):
    return incremental.pending(*_prompts(spark, d)).select("doc_id", "prompt_sha256")


# analytics over events

_NOW = "2024-01-20 00:00:00"


@query("select count(*) as n, round(avg(value), 6) as avg_value, round(sum(value), 4) as sum_value, count(distinct user_id) as users from events")
def usage_all(spark, d):
    return serving.usage(load(spark, d, "events"), "ts", _NOW, None, "user_id", "value")


@query("""
select count(*) as n, round(avg(value), 6) as avg_value, round(sum(value), 4) as sum_value, count(distinct user_id) as users from events where ts > (select max(ts) from events) - interval 7 day
""")
def usage_last_week(spark, d):
    e = load(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    return serving.usage(e, "ts", now, 7, "user_id", "value")


@query("select user_id, count(*) as n, round(avg(value), 6) as avg_value, round(sum(value), 4) as sum_value, min(ts) as first_ts, max(ts) as last_ts from events group by 1")
def user_stats(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"), F.round(F.sum("value"), 4).alias("sum_value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("select word, n from (select word, count(*) n from (select unnest(string_split_regex(lower(title), '[ \\t\\r\\n]+')) word from documents where title is not null) where length(word) > 3 group by 1) order by n desc, word limit 5")
def top_topics(spark, d):
    return serving.top_topics(_docs(spark, d), "title", 5)


@query("select event_id, user_id, event_type from events order by ts desc, event_id desc limit 20")
def recent_queries(spark, d):
    return load(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type")


@query("select event_type, count(*) as n, round(count(*) * 1.0 / sum(count(*)) over (), 6) as share from events group by 1")
def route_stats(spark, d):
    e = load(spark, d, "events")
    total = e.count()
    return e.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.lit(total), 6))


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 3599999999 microsecond preceding and current row) as in_window from events")
def rate_limit_window_counts(spark, d):
    return serving.window_counts(load(spark, d, "events"), "user_id", "ts", 3600, "event_id").select("event_id", "in_window")


@query("""with recursive e as materialized (select user_id k, event_id id, epoch_us(ts) / 1e6 s, row_number() over (partition by user_id order by ts, event_id) i from events where user_id is not null and ts is not null),
a as (select k, id, s, i, [s] held, true ok from e where i = 1
  union all select e.k, e.id, e.s, e.i, case when len(h) < 3 then list_append(h, e.s) else h end, len(h) < 3 from (select a.k, a.i, e.s es, list_filter(a.held, lambda x: x > e.s - 86400) h from a join e on e.k = a.k and e.i = a.i + 1) a join e on e.k = a.k and e.i = a.i + 1)
select k as key, id, ok as admitted from a""")
def rate_limit_admission(spark, d):
    return serving.admitted(load(spark, d, "events"), "user_id", "ts", "event_id", 86400.0, 3)


@query("""
select event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id, event_type order by ts, event_id)) <= 86400000000, false) as hit from events
""")
def ttl_expiry(spark, d):
    e = load(spark, d, "events").withColumn("k", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return serving.ttl_hits(e, "k", "ts", "event_id", 86400).select("event_id", "hit")


@query("select key, last_ts, last_id from (select user_id as key, max(ts) as last_ts, arg_max(event_id, (ts, event_id)) as last_id from events group by 1) order by last_ts desc, last_id desc limit 50")
def lru_eviction(spark, d):
    return serving.lru_resident(load(spark, d, "events"), "user_id", "ts", "event_id", 50)


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) r from events) where r <= 5")
def conversation_window(spark, d):
    return serving.memory_window(load(spark, d, "events"), "user_id", "event_id", 5).select("user_id", "event_id")


@query("select event_id, coalesce(string_agg(event_type, chr(10)) over (partition by user_id order by event_id rows between 3 preceding and 1 preceding), '') as context from events")
def conversation_context(spark, d):
    return serving.previous_turns(load(spark, d, "events"), "user_id", "event_id", "event_type").select("event_id", "context")


@query("select coalesce(event_type, 'all') as event_type, coalesce(user_id % 10, -1) as slot, count(*) as n from events group by grouping sets ((event_type, user_id % 10), (event_type), ())")
def usage_cube(spark, d):
    e = load(spark, d, "events").withColumn("slot", F.col("user_id") % 10)
    g = e.rollup("event_type", "slot").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("slot", F.lit(-1)).alias("slot"), "n")


# replies of models

_REPLY = "case doc_id % 4 when 0 then '0.9: fits' when 1 then '0.2: off' when 2 then 'no idea' else '0.5: half' end"


@query(f"""
with r as (select doc_id, {_REPLY} x from documents), g as (select doc_id, coalesce(try_cast(nullif(regexp_extract(x, '^\\s*([01](?:\\.\\d+)?)\\s*:', 1), '') as double), 0.5) grade, trim(regexp_extract(x, ':\\s*(.*)$', 1)) reason from r)
select doc_id, grade, reason from g where grade >= 0.5
""")
def graded_replies(spark, d):
    x = _docs(spark, d).select("doc_id", F.expr(_REPLY).alias("reply"))
    return models.graded(x, F.col("reply")).select("doc_id", "grade", "reason")


@query("select doc_id, case when len(w) > 20 or regexp_matches(lower(coalesce(title, '')), '(^|[^\\p{L}])(so sánh|compare|tại sao|why)([^\\p{L}]|$)') then 'complex' when len(w) > 8 then 'medium' else 'simple' end as route from (select *, coalesce(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+'), []) w from documents)")
def route_questions(spark, d):
    return _docs(spark, d).select("doc_id", models.route(F.coalesce("title", F.lit(""))).alias("route"))


@query("select doc_id, case when doc_id % 6 = 0 or doc_id % 4 = 0 then 'incorrect' when (doc_id % 4) * 2 >= doc_id % 6 then 'correct' else 'ambiguous' end as action from documents")
def corrective_actions(spark, d):
    return _docs(spark, d).select("doc_id", models.corrective_action(F.col("doc_id") % 6, F.col("doc_id") % 4).alias("action"))


@query("""
select tale_key as query_id, md5(string_agg('[S' || rank || '] Source: ' || coalesce(source, '') || chr(10) || coalesce(title, ''), chr(10) || chr(10) order by rank)) as context_md5
from (select tale_key, source, title, row_number() over (partition by tale_key order by doc_id) rank from documents where tale_key is not null) where rank <= 5 group by 1
""")
def context_assembly(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("tale_key").orderBy("doc_id")
    p = _docs(spark, d).filter("tale_key is not null").withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select(F.col("tale_key").alias("query_id"), "rank", "source", F.col("title").alias("text"))
    return models.context_blocks(p).select("query_id", F.md5("context").alias("context_md5"))


# Fixed values, of the SQL side: what says that nothing was found.
_NOTHING = "không có đủ thông tin|không đủ thông tin|không có thông tin|không tìm thấy thông tin|chưa có thông tin|không được đề cập|không đề cập|không được nhắc|don''t have enough information|do not have enough information|not enough information"


@query(f"select doc_id, coalesce(regexp_matches(replace({dialect.NORMAL.format('text')}, '’', ''''), '{_NOTHING}'), false) as abstains from documents")
def abstention(spark, d):
    return _docs(spark, d).select("doc_id", T.is_abstention(F.col("text")).alias("abstains"))
