"""SQL fragments, for oracles, of the text functions."""

from __future__ import annotations

from ..functions import text as T


def camel(t: str) -> str:
    out = f"replace({t}, '_', ' ')"
    for p in (r"([A-Z]+)([A-Z][^A-Z0-9 ])", r"([^A-Z0-9 ])([A-Z])", r"([^0-9 ])([0-9])", r"([0-9])([^0-9 ])"):
        out = f"regexp_replace({out}, '{p}', '\\1 \\2', 'g')"
    return out


def terms(x: str, n: int = 2) -> str:
    parts = f"list_filter(string_split(lower({camel('t')}), ' '), lambda p: p <> '')"
    one = f"list_concat([lower(t)], list_concat({parts}, case when len({parts}) >= 2 then [array_to_string([q[1] for q in {parts}], '')] else [] end))"
    return f"list_sort(list_distinct(list_filter(flatten([{one} for t in regexp_extract_all(coalesce({x}, ''), '[\\p{{L}}\\p{{N}}_]+')]), lambda z: length(z) >= {n})))"


def lit(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def signature() -> str:
    return terms("concat_ws(' ', content, array_to_string(labels, ' '), source_path)")


def overlap(query: str) -> str:
    hay = "lower(concat_ws(' ', content, array_to_string(labels, ' '), coalesce(source_path, '')))"
    direct = " + ".join(f"contains(hay, '{w}')::int" for w in query.lower().split())
    near = " + ".join(f"(list_contains(sig, '{t}') or len(list_filter(sig, lambda x: length(x) >= 3 and {len(t)} >= 3 and (contains(x, '{t}') or contains('{t}', x)))) > 0)::int" for t in T.driver_terms(query))
    return f"(select case when ({direct}) > 0 then ({direct}) else ({near}) end::double from (select {hay} as hay, {signature()} as sig) hs)"


def bm25(view: str, id_col: str, text_col: str, query: str, k1: float = 1.2, b: float = 0.75) -> str:
    """A select of (id, score)."""
    import re

    toks = sorted(set(re.findall(r"[a-z0-9_]+", query.lower())))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}'))::double as t{i}" for i, t in enumerate(toks))
    df = ", ".join(f"sum((t{i} > 0)::int)::double as d{i}" for i in range(len(toks)))
    score = " + ".join(f"ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) * t{i} * {k1 + 1} / (t{i} + {k1} * (1 - {b} + {b} * dl / avgdl))" for i in range(len(toks)))
    some = " or ".join(f"t{i} > 0" for i in range(len(toks)))
    return f"""select {id_col}, {score} as score from (select {id_col}, len(w)::double as dl, {tf} from (select {id_col}, regexp_extract_all(lower(coalesce({text_col}, '')), '[a-z0-9_]+') as w from {view}) x1) x2
      cross join (select count(*)::double as n, avg(dl) as avgdl, {df} from (select len(w)::double as dl, {tf} from (select regexp_extract_all(lower(coalesce({text_col}, '')), '[a-z0-9_]+') as w from {view}) x3) x4) x5 where {some}"""


def low_hash(t: str) -> str:
    return f"list_reduce(list_concat([5], [('0x' || substr(hex({t}), 2 * j + 1, 2))::int for j in range(strlen({t}))]), lambda a, b: (((xor(a, b) & 15) * 3) & 15))"


def raw_vector(sig: str) -> str:
    return f"[len(list_filter([{low_hash('tt')} for tt in {sig}], lambda x: x = i))::double * (case when i % 2 = 0 then 1 else -1 end) for i in range(16)]"


def near_flags(sig: str, query: str) -> list[str]:
    """For each term of the query whether a signature has one that equals it, holds it or is held by it."""
    out = []
    for t in T.driver_terms(query):
        part = f"len(list_filter({sig}, lambda x: length(x) >= 3 and (contains(x, '{t}') or contains('{t}', x)))) > 0" if len(t) >= 3 else "false"
        out.append(f"(list_contains({sig}, '{t}') or {part})::int")
    return out


def flag_sum(columns: list[str]) -> str:
    return "(" + " + ".join(columns) + ")"


FACT_TEXTS = """ft as (
  select f.fact_id, 'relation' as kind, concat_ws(' ', s.label, f.relation_type, o.label) as text, null::varchar as occurred_at, f.created, f.valid_from, f.valid_until, f.status from relations f join entities s on s.entity_id = f.src_id join entities o on o.entity_id = f.dst_id
  union all select f.fact_id, 'claim', concat_ws(' ', s.label, f.predicate, f.object), null, f.created, f.valid_from, f.valid_until, f.status from claims f join entities s on s.entity_id = f.subject_id
  union all select f.fact_id, 'event', concat_ws(' ', f.event_type, f.occurred_at, s.label), f.occurred_at, f.created, f.valid_from, f.valid_until, f.status from graph_events f left join entities s on s.entity_id = f.entity_id)"""


def hybrid(query: str, v: int, n: int, years: list[str], lists: str = 'bgswptu') -> str:
    """Common table expressions, on evl and the fact views, up to fused (key, rrf, sources) and h (what the rerank scores)."""
    words, q = query.lower().split(), T.driver_terms(query)
    hc, hm = "lower(coalesce(content, ''))", "lower(concat_ws(' ', array_to_string(labels, ' '), coalesce(source_path, '')))"
    flags = [f"contains({hc}, '{w}')::int as d{i}" for i, w in enumerate(words)] + [f"contains({hm}, '{w}')::int as e{i}" for i, w in enumerate(words)]
    nears = [f"{x} as n{i}" for i, x in enumerate(near_flags("tc", query))] + [f"{x} as m{i}" for i, x in enumerate(near_flags("tm", query))]
    direct = flag_sum([f"greatest(d{i}, e{i})" for i in range(len(words))])
    near = flag_sum([f"greatest(n{i}, m{i})" for i in range(len(q))])
    support = ", ".join([f"max(d{i}) as d{i}" for i in range(len(words))] + [f"max(n{i}) as n{i}" for i in range(len(q))])
    fdirect = flag_sum([f"greatest(d{i}, contains(lower(text), '{w}')::int)" for i, w in enumerate(words)])
    fnear = flag_sum([f"greatest(n{i}, {x})" for i, x in enumerate(near_flags("tt", query))])
    cos = "list_sum([a[1] * a[2] for a in list_zip(v, [" + ", ".join(map(repr, T.driver_vector(q))) + "])]) / sqrt(list_sum([y * y for y in v]))"
    visible = f"created <= {v} and valid_from <= {v} and (valid_until is null or valid_until >= {v})"
    ranked = lambda name, body, most, source: f"{name} as (select key, row_number() over (order by score desc, key) as rank, '{source}' as source from (select key, round(score, 9) as score from ({body}) y order by 2 desc, 1 limit {most}) x)"
    derived = min(8 * n, 512)
    told = "'community summary for ' || source_scope || ': entities ' || array_to_string(labels, ', ') || '; relations ' || coalesce(r, 0) || '; claims ' || coalesce(c, 0) || '; events ' || coalesce(e, 0)"
    return f"""{FACT_TEXTS},
  e0 as (select evidence_id, coalesce(parent_id, evidence_id) as key, source_scope, content, labels, source_path, {terms('content')} as tc, {terms("concat_ws(' ', array_to_string(labels, ' '), source_path)")} as tm from evl),
  e1 as (select *, {', '.join(flags + nears)}, list_distinct(tc || tm) as sig from e0),
  em as (select *, case when {direct} > 0 then {direct} else {near} end::double as o, len(list_intersect(sig, {lit(q)})) as c, len(sig) as z from e1),
  l1 as (select key, x.score from ({bm25('evl', 'evidence_id', 'content', query)}) x join em using (evidence_id)),
  {ranked('qb', 'select key, score from l1', 4 * n, 'bm25')},
  {ranked('qg', 'select key, o as score from em where o > 0', 4 * n, 'graph_evidence')},
  {ranked('qs', f'select key, c / {len(q)} + c / (z + {len(q)} - c) as score from em where c > 0', derived, 'semantic')},
  vv as (select key, o, {cos} as c from (select key, o, {raw_vector('sig')} as v from em where o > 0) w),
  {ranked('qw', f'select key, c + 0.05 * least(1, o / {len(q)}) as score from vv where c > 1e-12', derived, 'vector')},
  fe as (select fact_id, arg_min(key, pos) as key, {support} from fact_evidence join em using (evidence_id) group by fact_id),
  fs as (select fact_id, kind, occurred_at, key, case when {fdirect} > 0 then {fdirect} else {fnear} end::double as score from (select *, {terms('text')} as tt from ft) f join fe using (fact_id) where status = 'accepted' and {visible}),
  {ranked('qp', 'select key, score from fs where score > 0', 512, 'graph_path')},
  {ranked('qt', f"select key, 1 + score as score from fs where kind = 'event' and (" + ' or '.join(f"contains(occurred_at, '{y}')" for y in years) + ")", 512, 'temporal')},
  cl as (select source_scope, list_sort(list_distinct(flatten(list(labels))))[1:12] as labels from evl group by 1),
  cn as (select source_scope, count(distinct fact_id) filter (where kind = 'relation') as r, count(distinct fact_id) filter (where kind = 'claim') as c, count(distinct fact_id) filter (where kind = 'event') as e from fact_evidence join evl using (evidence_id) join ft using (fact_id) where ft.status = 'accepted' and ft.created <= {v} and valid_from <= {v} and (valid_until is null or valid_until >= {v}) group by 1),
  cs as (select 'community:' || source_scope || ':{v}' as key, {told} as content, labels, null::varchar as source_path from cl left join cn using (source_scope)),
  {ranked('qu', f'select key, 1 + {overlap(query)} as score from cs', 512, 'community_summary')},
  fused as (select key, sum(1.0::double / (60 + rank)) as rrf, list_sort(list(distinct source)) as sources from ({' union all '.join(f'select * from q{x}' for x in lists)}) a group by key order by round(rrf, 12) desc, key limit {n}),
  hk as (select key, string_agg(content, chr(10) order by evidence_id) as content, list_sort(list_distinct(flatten(list(labels)))) as labels, arg_min(source_path, evidence_id) filter (where source_path is not null) as source_path from em group by key
    union all select key, content, labels, source_path from cs),
  hf as (select key, list_sort(list(distinct text)) as facts from fact_evidence join em using (evidence_id) join ft using (fact_id) where {visible.replace('created', 'ft.created')} group by key),
  h as (select fused.*, coalesce(content, '') as content, labels, source_path, coalesce(facts, []) as facts from fused join hk using (key) left join hf using (key))"""
