"""SQL for the queries whose operators are not SQL themselves; brute force, on the whole tables."""

SUBSTRING = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), windows as (
  select doc_id, i, min(doc_id) over (partition by sha256(array_to_string(ws[i : i + 49], ' '))) as least
  from w, unnest(range(1, len(ws) - 48)) as u(i)
), gone as (
  select distinct doc_id, i + k as i from windows, unnest(range(0, 50)) as v(k) where least < doc_id
), kept as (
  select w.doc_id, count(gone.i)::bigint as n_removed, string_agg(case when gone.i is null then ws[u.i] end, ' ' order by u.i) as body
  from w, unnest(range(1, len(ws) + 1)) as u(i) left join gone on gone.doc_id = w.doc_id and gone.i = u.i group by w.doc_id
)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(body, '')) as kept_sha256 from w left join kept using (doc_id)
"""

_SETS = r"""
  select {id} as id, case when len(ws) = 0 then [] when len(ws) < {k} then [array_to_string(ws, ' ')]
    else list_distinct([array_to_string(ws[i : i + {k} - 1], ' ') for i in range(1, len(ws) - {k} + 2)]) end as s
  from (select {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from {table})
"""

NEAR_DUPLICATES = f"""
with recursive sets as ({_SETS.format(id="doc_id", k=4, table="documents")}),
x as (select id, len(s) as n, unnest(s) as g from sets),
pairs as (
  select a.id as a, b.id as b, a.n as na, b.n as nb, count(*) as c from x a join x b on a.g = b.g and a.id < b.id
  where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all
), links as (
  select a, b from pairs where 100 * c >= 80 * (na + nb - c)
), sides as (select a, b from links union select b, a from links),
reach(id, r) as (select id, id from sets union select sides.b, reach.r from reach join sides on sides.a = reach.id and reach.r < sides.b)
select id as doc_id, (select len(s) from sets where sets.id = reach.id)::bigint as n_shingles, min(r) as component_id, min(r) = id as kept from reach group by id
"""

CONTAINED = f"""
with docs as ({_SETS.format(id="doc_id", k=5, table="documents")}),
items as ({_SETS.format(id="item_id", k=5, table="benchmark")}),
d as (select id, unnest(s) as g from docs), i as (select id, len(s) as n, unnest(s) as g from items)
select d.id as doc_id, i.id as item_id, i.n::bigint as n_item, count(*)::bigint as n_shared, count(*) / i.n as containment
from d join i using (g) group by d.id, i.id, i.n having 100 * count(*) >= 80 * i.n
"""
