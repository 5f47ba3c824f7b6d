"""DuckDB statements of the operators that SQL can express; op1's stands beside its operator."""

WORD_LIST = r"coalesce(regexp_extract_all({text}, '[^\x20\x09-\x0D]+'), [])"

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), s as (
  select q.vec_id as query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])), 0)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 100 = 0
)
select query_id, "rank", vec_id, score from (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as "rank", vec_id, score from s)
where "rank" <= 10
"""

NEAR_VECTORS = """
with recursive v as (
  select vec_id, embedding::double[] as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x)) / sqrt(list_inner_product(b.x, b.x)) >= 0.9
), reach as (
  select vec_id as id, vec_id as root from embeddings union select l.b, r.root from reach r join links l on l.a = r.id
), c as (select id, min(root) as component_id from reach group by id)
select vec_id, (select count(*) from links where a = vec_id)::bigint as n_links, component_id, vec_id = component_id as kept from embeddings join c on id = vec_id
"""

SUBSTRINGS = f"""
with d as (select doc_id, {WORD_LIST.format(text='text')} as ws from documents),
w as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word, ws from d),
g as (select doc_id, i, word, case when i + 49 <= len(ws) then md5(array_to_string(ws[i:i + 49], ' ')) end as h from w),
l as (select h, min(doc_id) as low from g where h is not null group by h),
f as (select g.doc_id, i, word, coalesce(low < g.doc_id, false) as late from g left join l using (h)),
m as (select *, max(late::int) over (partition by doc_id order by i rows between 49 preceding and current row) = 1 as gone from f),
k as (select doc_id, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by i) filter (where not gone) as kept from m group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""

NEAR_DOCUMENTS = f"""
with recursive d as (select doc_id, {WORD_LIST.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as id, doc_id as root from documents union select l.b, r.root from reach r join both_ways l on l.a = r.id),
c as (select id, min(root) as component_id from reach group by id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id from d left join n using (doc_id) join c on c.id = d.doc_id
"""
