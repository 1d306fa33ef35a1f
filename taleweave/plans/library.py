"""Queries of record tables, answer benchmarks, stories as built, and of files written and
read again, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from taleweave.functions import text as T
from taleweave.operators import evaluation, library, serving, stories
from taleweave.plans import dialect
from taleweave.session import load, shared_folder
from taleweave.sources import loaders, sinks

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _records(spark, d):
    """Chunks as records: the topic as name, the period as category, characters as tags."""
    c = load(spark, d, "chunk_metadata")
    return c.select("chunk_row_id", "topic", F.coalesce("time_period", F.lit("none")).alias("category"), F.coalesce("sentiment", F.lit("none")).alias("status"), F.col("characters").alias("tags"))


_REC = "rec as (select chunk_row_id, topic, coalesce(time_period, 'none') category, coalesce(sentiment, 'none') status, characters tags from chunk_metadata)"


@query(f"with {_REC} select chunk_row_id from rec where status = 'vui' and category = 'long ago' and list_has_any(coalesce(tags, []), ['Quạ Ba Mắt', 'Bành Quỳnh Đằng'])")
def records_listed(spark, d):
    return library.listed(_records(spark, d), "vui", "long ago", ["Quạ Ba Mắt", "Bành Quỳnh Đằng"]).select("chunk_row_id")


@query(f"with {_REC} select chunk_row_id from rec where contains(lower(topic), 'fox') or contains(lower(category), 'fox') or contains(lower(coalesce(array_to_string(tags, ' '), '')), 'fox')")
def records_searched(spark, d):
    return library.searched(_records(spark, d), "FOX", ["topic", "category"], "tags").select("chunk_row_id")


@query(f"with {_REC} select chunk_row_id from rec where coalesce(contains(lower(topic), 'long'), false) or coalesce(contains(lower(category), 'long'), false) or coalesce(len(list_filter(tags, lambda t: contains(lower(t), 'long'))) > 0, false)")
def library_searched(spark, d):
    return library.in_library(_records(spark, d), "Long", ["topic", "category"], "tags").select("chunk_row_id")


@query(f"with {_REC} select chunk_row_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(coalesce(tags, []), lambda t: t is not null), ['kept', 'read']))), '|') as added, array_to_string(list_filter(coalesce(tags, []), lambda t: t is not null and t <> 'Quạ Ba Mắt'), '|') as removed from rec")
def tags_changed(spark, d):
    x = _records(spark, d)
    return x.select("chunk_row_id", F.array_join(library.tagged(F.col("tags"), ["kept", "read"]), "|").alias("added"), F.array_join(library.untagged(F.col("tags"), ["Quạ Ba Mắt"]), "|").alias("removed"))


_KEYS = "k as (select event_id api_key, user_id, event_type <> 'error' is_active, case when event_id % 4 <> 0 then ts + interval 5 day end expires_at, case event_id % 3 when 0 then ['read'] when 1 then ['read', 'write'] else [] end permissions from events), u as (select distinct user_id, user_id % 7 <> 0 is_active from events), nw as (select max(ts) t from events)"


def _keys(spark, d):
    e = load(spark, d, "events")
    i = F.col("event_id")
    keys = e.select(i.alias("api_key"), "user_id", (F.col("event_type") != "error").alias("is_active"), F.when(i % 4 != 0, F.expr("ts + interval 5 day")).alias("expires_at"), F.when(i % 3 == 0, F.array(F.lit("read"))).when(i % 3 == 1, F.array(F.lit("read"), F.lit("write"))).otherwise(F.array().cast("array<string>")).alias("permissions"))
    return keys, e.select("user_id", (F.col("user_id") % 7 != 0).alias("is_active")).distinct(), e


@query(f"with {_KEYS} select api_key from k join u using (user_id), nw where k.is_active and (expires_at is null or expires_at >= t) and u.is_active")
def keys_valid(spark, d):
    keys, users, e = _keys(spark, d)
    now = e.agg(F.max("ts")).first()[0]
    return library.valid_keys(keys, users, F.lit(now).cast("timestamp_ntz")).select("api_key")


@query(f"with {_KEYS}, a as (select api_key, permission from (select api_key from k) cross join (select unnest(['read', 'write']) permission)) select a.api_key, permission, coalesce(is_active and list_contains(permissions, permission), false) as allowed from a left join k using (api_key)")
def keys_permitted(spark, d):
    keys, _, _ = _keys(spark, d)
    asked = keys.select("api_key", F.explode(F.array(F.lit("read"), F.lit("write"))).alias("permission"))
    return library.permitted(asked, keys).select("api_key", "permission", "allowed")


@query(f"""with r as (select {dialect.NORMAL.format('x.source')} a, {dialect.NORMAL.format('x.target')} b, 'parent' as kind from (select unnest(relationships) x from document_graphs))
select a, b, kind from r union select b, a, 'child' from r""")
def relations_mutual(spark, d):
    r = load(spark, d, "document_graphs").select(F.explode("relationships").alias("x")).select(T.normal(F.col("x.source")).alias("a"), T.normal(F.col("x.target")).alias("b"), F.lit("parent").alias("kind"))
    return library.mutual(r, {"parent": "child"})


@query("""
select document_key as key, sha256(string_agg(topic, chr(10) || chr(10) order by chunk_index, chunk_row_id)) as sha256, count(*) as n_pages from chunk_metadata where trim(topic) <> '' and document_key is not null group by 1
""")
def document_texts(spark, d):
    """Documents put together from their chunks' topics."""
    x = load(spark, d, "chunk_metadata").filter("document_key is not null")
    return library.document_texts(x, "document_key", ["chunk_index", "chunk_row_id"], "topic").select("key", "sha256", "n_pages")


_LIMITS = "l as (select distinct user_id k, cast(user_id % 3 + 1 as int) n, cast(3600 * (user_id % 2 + 1) as double) w from events where user_id % 5 <> 0)"


@query(f"""with recursive {_LIMITS}, e as materialized (select user_id k, event_id id, epoch_us(ts) / 1e6 s, coalesce(n, 100) n, coalesce(w, 60.0) w, row_number() over (partition by user_id order by ts, event_id) i from events left join l on l.k = user_id where user_id is not null and ts is not null),
a as (select k, id, s, i, [s] held, true ok from e where i = 1
  union all select e.k, e.id, e.s, e.i, case when len(h) < e.n then list_append(h, e.s) else h end, len(h) < e.n from (select a.k, a.i, list_filter(a.held, lambda x: x > e.s - e.w) h from a join e on e.k = a.k and e.i = a.i + 1) a join e on e.k = a.k and e.i = a.i + 1)
select k as key, id, ok as admitted from a""")
def limits_by_key(spark, d):
    e = load(spark, d, "events")
    limits = e.filter("user_id % 5 <> 0").select(F.col("user_id").alias("key"), (F.col("user_id") % 3 + 1).cast("int").alias("max_requests"), (3600 * (F.col("user_id") % 2 + 1)).cast("double").alias("window_s")).distinct()
    return serving.admitted_by_limits(e, limits, "user_id", "ts", "event_id")


@query("select event_id, greatest(5 - count(*) over (partition by user_id order by ts range between interval 3599999999 microsecond preceding and current row), 0) as remaining from events")
def limit_remaining(spark, d):
    c = serving.window_counts(load(spark, d, "events"), "user_id", "ts", 3600, "event_id")
    return serving.remaining(c, 5).select("event_id", "remaining")


@query("select user_id, string_agg(case when event_type = 'login' then 'User' else 'Assistant' end || ': ' || event_type, chr(10) order by event_id) as context from (select *, row_number() over (partition by user_id order by event_id desc) r from events) where r <= 4 group by 1")
def memory_context(spark, d):
    e = load(spark, d, "events").withColumn("role", F.when(F.col("event_type") == "login", "user").otherwise("assistant"))
    return serving.context_string(e, "user_id", "event_id", "role", "event_type", 4)


@query(f"select doc_id, sha256({dialect.NORMAL.format('title')} || '|' || coalesce(lang, 'none')) as query_key from documents where title is not null")
def query_keys(spark, d):
    x = load(spark, d, "documents").filter("title is not null")
    return x.select("doc_id", serving.query_key(F.col("title"), F.coalesce("lang", F.lit("none"))).alias("query_key"))


# answers

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_NOTHING = "không có đủ thông tin|không đủ thông tin|không có thông tin|không tìm thấy thông tin|chưa có thông tin|không được đề cập|không đề cập|không được nhắc|don''t have enough information|do not have enough information|not enough information"
_ANSWERS = f"""an as (select doc_id, doc_id % 5 <> 0 answerable, title reference, case when doc_id % 7 = 0 then 'We do not have enough information.' when doc_id % 3 = 0 then coalesce(substr(title, 1, 40), '') || ' [S1]' else substr(text, 1, 200) end answer, coalesce(source, 'none') tag,
  cast(doc_id % 4 as int) calls, cast(doc_id % 1000 as double) latency, case when doc_id % 50 = 0 then 'failed' end error from documents),
cs as (select *, regexp_matches({dialect.NORMAL.format("coalesce(answer, '')")}, '{_NOTHING}') abstained, case when answerable then regexp_matches(coalesce(answer, ''), '\\[S\\d+\\]') end cited, list_distinct({_WORDS.format('reference')}) rw, {_WORDS.format("coalesce(answer, '')")} aw from an),
cr as (select *, case when answerable and len(rw) > 0 then len(list_intersect(rw, aw)) / len(rw) end recall from cs)"""


def _answers(spark, d):
    i = F.col("doc_id")
    answer = F.when(i % 7 == 0, "We do not have enough information.").when(i % 3 == 0, F.concat(F.coalesce(F.substring("title", 1, 40), F.lit("")), F.lit(" [S1]"))).otherwise(F.substring("text", 1, 200))
    x = load(spark, d, "documents").select(i.alias("case_id"), F.col("title").alias("question"), (i % 5 != 0).alias("answerable"), F.col("title").alias("reference"), answer.alias("answer"), F.array(F.coalesce("source", F.lit("none"))).alias("tags"), (i % 4).cast("int").alias("calls"), (i % 1000).cast("double").alias("latency_ms"), F.when(i % 50 == 0, "failed").alias("error"))
    return evaluation.answer_cases(x)


@query(f"with {_ANSWERS} select doc_id as case_id, abstained, cited, round(recall, 6) as answer_recall from cr")
def answer_cases(spark, d):
    """Answers replayed for every document's title."""
    return _answers(spark, d).select("case_id", "abstained", "cited", F.round("answer_recall", 6).alias("answer_recall"))


@query(f"""with {_ANSWERS} select count(*) as cases, count(*) filter (where answerable) as answerable_cases, count(*) filter (where not answerable) as unanswerable_cases, round(avg(recall), 6) as answer_recall, round(avg(cited::int), 6) as citation_rate,
  round(avg(abstained::int) filter (where answerable), 6) as false_abstention_rate, round(avg(abstained::int) filter (where not answerable), 6) as abstention_accuracy, round(avg(calls), 6) as llm_calls_per_query, round(quantile_cont(latency, 0.5), 6) as latency_p50_ms, round(quantile_cont(latency, 0.95), 6) as latency_p95_ms, count(error) as errors from cr""")
def answer_summary(spark, d):
    return evaluation.answer_summary(_answers(spark, d))


@query(f"with {_ANSWERS} select tag, count(*) as n, round(avg(recall), 6) as answer_recall, round(avg(abstained::int), 6) as false_abstention_rate from cr where answerable group by 1")
def answer_by_tag(spark, d):
    return evaluation.answer_by_tag(_answers(spark, d))


# stories

_CATALOG = {"boat": ["thuyen", "boat", "barque"], "bread": ["bread", "pain dur", "banh"], "bell": ["chuong", "bell", "cloche"]}


def _matched(of: str) -> str:
    return "[" + ", ".join(f"case when {' or '.join(f'''contains({of}, '{k}')''' for k in ks)} then '{c}' end" for c, ks in sorted(_CATALOG.items())) + "]"


_ASKED = "the old boat and a bell"


@query(f"""with s as (select story_row_id, {dialect.KEY.format('text')} tk from stories where text is not null), m as (select story_row_id, list_filter(list_intersect({_matched('tk')}, {_matched(f"'{_ASKED}'")}), lambda x: x is not null) m, len(list_intersect(list_distinct(string_split(tk, ' ')), list_distinct(string_split('{_ASKED}', ' ')))) s from s)
select story_row_id, array_to_string(list_sort(m), ',') as matched, round(s + case when len(m) > 0 then 2.0 + len(m) else 0.0 end, 6) as score from m where s + case when len(m) > 0 then 2.0 + len(m) else 0.0 end > 1""")
def motif_search(spark, d):
    """Stories of the labels a question has, above a score of 1."""
    s = load(spark, d, "stories").filter("text is not null").select("story_row_id", "text")
    words = F.array_distinct(F.split(F.lit(_ASKED), " "))
    shared = F.size(F.array_intersect(F.array_distinct(F.split(T.match_key(F.col("text")), " ")), words)).cast("double")
    x = stories.found_labels(s.withColumn("s", shared), _ASKED, _CATALOG, F.col("s"), 1.0)
    return x.select("story_row_id", F.array_join(F.array_sort("matched"), ",").alias("matched"), F.round("boosted", 6).alias("score"))


@query(f"""with s as (select story_row_id, {dialect.STRIP.format('text')} x from stories where text is not null)
select story_row_id, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])((?:nui|song|bien|hang|lang|kinh do|vuong quoc)\\s+[a-zA-Z]+)', 1))), '|') as places from s""")
def location_phrases(spark, d):
    x = load(spark, d, "stories").filter("text is not null")
    return x.select("story_row_id", F.array_join(F.array_sort(stories.location_phrases(F.col("text"))), "|").alias("places"))


@query("""select doc_id, case when regexp_matches(lower(text), '[àáảãạăắằẳẵặâấầẩẫậđèéẻẽẹêếềểễệòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữự]|thach|sanh|tam|cam|vua|cong chua') then 'vi' else 'unknown' end as language from documents where text is not null""")
def built_language(spark, d):
    return load(spark, d, "documents").filter("text is not null").select("doc_id", stories.built_language(F.col("text")).alias("language"))


@query("""with c as (select coalesce(title, '') title, coalesce(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\p{Z}]+$', '', 'g'), '') text from stories)
select substr(sha1(title || chr(10) || text), 1, 16) as story_id, title, cast(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) as int) as word_count from c""")
def built_records(spark, d):
    return stories.built_records(load(spark, d, "stories"), _CATALOG).select("story_id", "title", "word_count")


# files

def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("select 'q' || doc_id as id, title as question, len(case when source is null then [] else [source] end) as n_sources, 0 as n_tags from documents where title is not null")
def golden_cases(spark, d):
    """Cases written as JSON lines and loaded; lists that are missing are empty."""
    at = _place(spark, "golden")
    x = load(spark, d, "documents").filter("title is not null")
    sinks.export_json(x.select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("id"), F.col("title").alias("question"), F.when(F.col("source").isNotNull(), F.array("source")).alias("sources")), at)
    return loaders.golden_set(spark, at).select("id", "question", F.size("sources").alias("n_sources"), F.size("tags").alias("n_tags"))


@query("select 'csv' as file_type, 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_nationkey: ' || c_nationkey || chr(10) || 'c_mktsegment: ' || c_mktsegment as text from customer")
def csv_files(spark, d):
    """Every customer written to CSV files, found in their folder and loaded as documents."""
    at = _place(spark, "csv")
    load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.csv(at, header=True)
    return loaders.documents(loaders.files(spark, at, "*.csv")).select("file_type", "text")


@query("select doc_id, source, case when doc_id % 3 = 0 then title || ' *' else title end as title from documents")
def versioned_table(spark, d):
    """A table written, its rows of every third id replaced, and its current version read."""
    at = _place(spark, "table")
    x = load(spark, d, "documents").select("doc_id", "source", "title")
    sinks.write_versioned(x, at)
    sinks.upsert_table(spark, at, x.filter("doc_id % 3 = 0").withColumn("title", F.concat("title", F.lit(" *"))), ["doc_id"])
    return sinks.read_current(spark, at)


@query("select coalesce(lang, 'none') as category, count(*) as n from documents group by 1")
def placed_by_category(spark, d):
    """Documents placed in a folder for each language, and read from them."""
    at = _place(spark, "placed")
    sinks.place_by_category(load(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("category")), at)
    return spark.read.parquet(at).groupBy("category").agg(F.count("*").alias("n"))
