"""Registered queries of scalar text functions, retrievers, fusion and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import readmodel as RM
from ..operators import retrieval as R
from ..sources import store
from ..sources.adapter import by_keys, view, with_views
from ..sources.scratch import scratch
from . import sqltext as S

V = 6
TEXT_QUERY = "idiot trash license"
MIXED_QUERY = "license version NATION_3"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views)
        return f

    return register


def labelled(spark: SparkSession, d: str, v: int | None = V, scope: str | None = None) -> DataFrame:
    """Evidence that is retrievable at a version, or all of it, with its entity labels, sorted."""
    ev = view(spark, d, "evidence")
    ev = ev if v is None else ev.where(R.retrievable(v, scope))
    lab = view(spark, d, "evidence_entities").join(view(spark, d, "entities"), "entity_id").groupBy("evidence_id").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    return ev.join(lab, "evidence_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


VISIBLE = f"created <= {V} and valid_from <= {V} and (valid_until is null or valid_until >= {V})"
EVL = f"evl as (select e.*, coalesce(l.labels, []) as labels from evidence e left join (select evidence_id, list_sort(list(label)) as labels from evidence_entities join entities using (entity_id) group by evidence_id) l using (evidence_id) where e.created <= {V} and e.status in ('accepted', 'proposed'))"
EV = ("evidence", "evidence_entities", "entities")


def r6(c):
    return F.round(c, 6)


def fact_texts(spark: SparkSession, d: str) -> DataFrame:
    """(fact_id, kind, text, occurred_at, visibility) of all facts: subject, predicate and object as one text."""
    ent = lambda key, label: by_keys(view(spark, d, "entities").select(F.col("entity_id").alias(key), F.col("label").alias(label)))
    seen = ["created", "valid_from", "valid_until", "status"]
    shape = lambda df, kind, parts, at: df.select("fact_id", F.lit(kind).alias("kind"), F.concat_ws(" ", *parts).alias("text"), at.alias("occurred_at"), *seen)
    rel = view(spark, d, "relations").join(ent("src_id", "a"), "src_id").join(ent("dst_id", "b"), "dst_id")
    cla = view(spark, d, "claims").join(ent("subject_id", "a"), "subject_id")
    eve = view(spark, d, "graph_events").join(ent("entity_id", "a"), "entity_id", "left")
    none = F.lit(None).cast("string")
    return shape(rel, "relation", ["a", "relation_type", "b"], none).union(shape(cla, "claim", ["a", "predicate", "object"], none)).union(shape(eve, "event", ["event_type", "occurred_at", "a"], F.col("occurred_at")))


_models: dict[tuple[str, str], RM.ReadModel] = {}


def read_model(spark: SparkSession, d: str) -> RM.ReadModel:
    """The stored read model of a folder's tables, which never change; written on first use in a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _models:
        _models[key] = build_read_model(spark, d)
    return _models[key]


def build_read_model(spark: SparkSession, d: str) -> RM.ReadModel:
    return RM.build(labelled(spark, d, None), fact_texts(spark, d), view(spark, d, "fact_evidence"), scratch(spark, "readmodel"))


# --- scalars -------------------------------------------------------------------------------------------


@query(f"select cast(p_partkey as bigint) as id, array_to_string({S.terms('x', 2)}, ' ') as terms from (select p_partkey, concat('GraphRAG', replace(p_name, ' ', '_'), 'HTTPClient', cast(p_size as varchar), ' ', p_type) as x from part) q")
def identifier_terms(spark, d):
    p = view(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("GraphRAG"), F.regexp_replace("p_name", " ", "_"), F.lit("HTTPClient"), F.col("p_size").cast("string"), F.lit(" "), F.col("p_type")).alias("x"))
    return p.select("id", F.array_join(T.terms(F.col("x")), " ").alias("terms"))


@query("select cast(p_partkey as bigint) as id, case when len(ps) >= 2 then array_to_string([q[1] for q in ps], '') end as acronym from (select p_partkey, list_filter(string_split(lower(" + S.camel("replace(p_name, ' ', '_')") + "), ' '), lambda p: p <> '') as ps from part) x")
def acronym_terms(spark, d):
    return view(spark, d, "part").select(F.col("p_partkey").alias("id"), T.let(T.parts(F.regexp_replace("p_name", " ", "_")), T.acronym).alias("acronym"))


@query(f"with {EVL} select evidence_id, len(sig)::bigint as n_terms, array_to_string(sig[1:8], ' ') as first_terms from (select evidence_id, {S.signature()} as sig from evl) x", *EV)
def token_signature(spark, d):
    s = T.token_signature(F.col("content"), F.col("labels"), F.col("source_path"))
    return labelled(spark, d).select("evidence_id", s.alias("sig")).select("evidence_id", F.size("sig").cast("long").alias("n_terms"), F.array_join(F.slice("sig", 1, 8), " ").alias("first_terms"))


@query(f"select evidence_id, array_to_string([(case when x = 0 then 0.0::double else round(x / sqrt(list_sum([y * y for y in v])), 6) end)::varchar for x in v], ' ') as vector from (select evidence_id, {S.raw_vector('sig')} as v from (select concat('part:', p_partkey::varchar) as evidence_id, {S.terms('p_name')} as sig from part) a) b")
def hashed_vector(spark, d):
    p = view(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("evidence_id"), T.hashed_vector(T.terms(F.col("p_name"))).alias("v"))
    return p.select("evidence_id", F.array_join(F.transform("v", lambda x: r6(x).cast("string")), " ").alias("vector"))


@query("select distinct entity_id, n::int as n, substr(lower(trim(label)), i::int, n::int) as gram from entities, unnest([1, 2, 3]) as a(n), unnest(range(1, length(label) + 1)) as b(i) where entity_id like 'nation:%' and i + n - 1 <= length(trim(label))", "entities")
def label_grams(spark, d):
    e = view(spark, d, "entities").where("entity_id like 'nation:%'")
    each = F.array(*[F.struct(F.lit(n).alias("n"), T.grams(F.col("label"), n).alias("g")) for n in (1, 2, 3)])
    return e.select("entity_id", F.explode(each).alias("x")).select("entity_id", "x.n", F.explode("x.g").alias("gram"))


@query(r"""select s, case when ok then y end as y, case when ok then m end as m, case when ok then dd end as d from (
  select s, y, m, dd, y is not null and coalesce(m between 1 and 12, true) and coalesce(dd between 1 and 31, true) as ok from (
  select s, nullif(regexp_extract(trim(s), p, 1), '')::int as y, nullif(regexp_extract(trim(s), p, 2), '')::int as m, nullif(regexp_extract(trim(s), p, 3), '')::int as dd from (
  select distinct substr(cast(o_orderdate as varchar), 1, (4 + 3 * (o_orderkey % 3))::int) as s, '^(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2}))?)?(?:[T ].*)?$' as p from orders union all select '2024-13', '^(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2}))?)?(?:[T ].*)?$' union all select 'soon', '^(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2}))?)?(?:[T ].*)?$') a) b) c""")
def partial_date_parse(spark, d):
    o = view(spark, d, "orders").select(F.expr("substr(cast(o_orderdate as string), 1, cast(4 + 3 * (o_orderkey % 3) as int))").alias("s")).distinct().union(spark.sql("select '2024-13' union all select 'soon'"))
    return o.select("s", T.partial_date(F.col("s")).alias("p")).select("s", "p.y", "p.m", "p.d")


@query("select c_custkey as id, cast(round(greatest(0, least(1, c_acctbal / 10000)) * 10000) as int) as bp, case when length(c_name) <= 12 then c_name else concat(substr(c_name, 1, 11), '…') end as label from customer")
def confidence_and_labels(spark, d):
    return view(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.basis_points(F.col("c_acctbal") / 10000).alias("bp"), T.truncate_label(F.col("c_name"), 12).alias("label"))


# --- visibility and facts ------------------------------------------------------------------------------


@query(f"select kind, count(*)::bigint as n, min(fact_id) as first from facts where {VISIBLE} group by kind", "facts")
def visible_at_version(spark, d):
    return view(spark, d, "facts").where(R.visible_at(V)).groupBy("kind").agg(F.count("*").alias("n"), F.min("fact_id").alias("first"))


@query("select source_scope, status, count(*)::bigint as n from evidence where status in ('accepted', 'proposed') group by all", "evidence")
def status_filter(spark, d):
    return view(spark, d, "evidence").where(F.col("status").isin("accepted", "proposed")).groupBy("source_scope", "status").agg(F.count("*").alias("n"))


@query("select entity_id, label from entities where entity_id not in (select entity_id from evidence_entities) and entity_id not in (select src_id from relations) and entity_id not in (select dst_id from relations) and entity_id not in (select subject_id from claims where status = 'accepted') and entity_id not in (select entity_id from graph_events)", "entities", "evidence_entities", "relations", "claims", "graph_events")
def orphan_entities(spark, d):
    accepted = lambda n: view(spark, d, n).where("status = 'accepted'") if n == "claims" else view(spark, d, n)
    return store.orphans(accepted).select("entity_id", "label")


@query("select kind, count(*)::bigint as missing, min(fact_id) as first from facts join fact_evidence using (fact_id) left join evidence using (evidence_id) where evidence.evidence_id is null or evidence.source_scope = 'src3' group by kind", "facts", "fact_evidence", "evidence")
def evidence_fk_violations(spark, d):
    """References to evidence that doesn't exist or lies in another scope than may be referred to."""
    fe = store.missing_evidence(view(spark, d, "fact_evidence"), view(spark, d, "evidence").where("source_scope <> 'src3'"))
    return view(spark, d, "facts").join(fe, "fact_id").groupBy("kind").agg(F.count("*").alias("missing"), F.min("fact_id").alias("first"))


@query(f"select fact_id, count(*)::bigint as n, string_agg(evidence_id, ' ' order by pos) as support from relations join fact_evidence using (fact_id) join evidence using (evidence_id) where relations.created <= {V} and evidence.created <= {V} and evidence.status in ('accepted', 'proposed') group by fact_id", "relations", "fact_evidence", "evidence")
def fact_evidence_support(spark, d):
    ev = view(spark, d, "evidence").where(R.retrievable(V)).select("evidence_id")
    rel = view(spark, d, "relations").where(F.col("created") <= V).select("fact_id")
    x = view(spark, d, "fact_evidence").join(rel, "fact_id").join(ev, "evidence_id")
    return x.groupBy("fact_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence_id"))), lambda s: s["evidence_id"]), " ").alias("support"))


@query(f"select source_scope, kind, count(distinct fact_id)::bigint as n from facts join fact_evidence using (fact_id) join evidence using (evidence_id) where facts.status = 'accepted' and facts.created <= {V} and valid_from <= {V} and (valid_until is null or valid_until >= {V}) group by all", "facts", "fact_evidence", "evidence")
def fact_counts_by_scope(spark, d):
    f = view(spark, d, "facts").where(R.visible_at(V) & (F.col("status") == "accepted")).select("fact_id", "kind")
    x = f.join(view(spark, d, "fact_evidence"), "fact_id").join(view(spark, d, "evidence").select("evidence_id", "source_scope"), "evidence_id")
    return x.groupBy("source_scope", "kind").agg(F.count_distinct("fact_id").alias("n"))


@query("select coalesce(parent_id, evidence_id) as grp, count(*)::bigint as n, min(evidence_id) as first from evidence group by 1 having count(*) > 1", "evidence")
def parent_grouping(spark, d):
    return view(spark, d, "evidence").groupBy(F.coalesce("parent_id", "evidence_id").alias("grp")).agg(F.count("*").alias("n"), F.min("evidence_id").alias("first")).where("n > 1")


@query("select 'entities' as item, count(*)::bigint as n from entities union all select 'evidence', count(*) from evidence union all select kind, count(*) from facts group by kind", "entities", "evidence", "facts")
def graph_inspect(spark, d):
    one = lambda name: view(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
    return one("entities").union(one("evidence")).union(view(spark, d, "facts").groupBy(F.col("kind").alias("item")).agg(F.count("*").alias("n")))


# --- retrievers ----------------------------------------------------------------------------------------


@query(f"with {EVL} select evidence_id, round(score, 6) as score from ({S.bm25('evl', 'evidence_id', 'content', TEXT_QUERY)}) x order by round(x.score, 9) desc, evidence_id limit 40", *EV)
def bm25_topk(spark, d):
    m = read_model(spark, d)
    hits = m.bm25(m.hits(TEXT_QUERY, V)).select("evidence_id", F.round("score", 9).alias("score"))
    return R.top(hits, 40).select("evidence_id", r6("score").alias("score"))


@query(f"with ev as (select * from evidence where source_scope = 'src3' and created <= {V} and status in ('accepted', 'proposed')) select evidence_id, round(score, 6) as score from ({S.bm25('ev', 'evidence_id', 'content', 'the license of')}) x order by x.score desc, evidence_id limit 20", "evidence")
def bm25_filtered_scope(spark, d):
    ev = view(spark, d, "evidence").where(R.retrievable(V, "src3"))
    return R.top(R.bm25(ev, "the license of"), 20).select("evidence_id", r6("score").alias("score"))


@query(f"with {EVL} select evidence_id, 1.0::double as score from evl where list_contains([lower(x) for x in labels], 'nation_3') or lower(content) = 'nation_3' order by evidence_id limit 200", *EV)
def fallback_exact(spark, d):
    ev = labelled(spark, d)
    hit = F.array_contains(F.transform("labels", F.lower), "nation_3") | (F.lower("content") == "nation_3")
    return ev.where(hit).select("evidence_id", F.lit(1.0).alias("score")).orderBy("evidence_id").limit(200)


@query(f"with {EVL} select evidence_id, 0.5::double as score from evl where contains(lower(content), 'worthless') or contains(lower(source_path), 'worthless') order by evidence_id limit 200", *EV)
def fallback_like(spark, d):
    ev = labelled(spark, d)
    return ev.where(F.lower("content").contains("worthless") | F.lower("source_path").contains("worthless")).select("evidence_id", F.lit(0.5).alias("score")).orderBy("evidence_id").limit(200)


@query("""with q as (select 'ntion_7' as q), g as (select distinct substr(q, i::int, 2) as g from q, unnest(range(1, length(q))) as u(i)),
  e as (select entity_id, lower(trim(label)) as name from entities where length(trim(label)) between 5 and 9),
  s as (select entity_id, name, count(distinct g.g) as shared from e join g on contains(name, g.g) group by all)
  select entity_id, name, levenshtein(name, 'ntion_7')::int as distance, (0.25 + 0.01 * (2 - levenshtein(name, 'ntion_7')))::double as score from s where shared >= 2 and levenshtein(name, 'ntion_7') <= 2 order by distance, name, entity_id limit 200""", "entities")
def fallback_fuzzy_labels(spark, d):
    """Labels that share grams with the query, in a length band, within two edits."""
    q, most, size = "ntion_7", 2, 2
    grams = sorted({q[i : i + size] for i in range(len(q) - size + 1)})
    e = view(spark, d, "entities").select("entity_id", F.lower(F.trim("label")).alias("name")).where(F.length("name").between(len(q) - most, len(q) + most))
    shared = F.size(F.array_intersect(T.grams(F.col("name"), size), T.lit_array(grams)))
    dist = F.levenshtein("name", F.lit(q), most)
    near = e.where(shared >= max(1, len(grams) - most * size)).withColumn("distance", dist).where("distance >= 0")
    return near.select("entity_id", "name", "distance", (0.25 + 0.01 * (most - F.col("distance"))).alias("score")).orderBy("distance", "name", "entity_id").limit(200)


@query(f"with {EVL} select grp as evidence_id, round(score, 6) as score from (select coalesce(parent_id, evidence_id) as grp, {S.overlap(MIXED_QUERY)} as score from evl) x where score > 0 order by score desc, grp limit 40", *EV)
def graph_evidence_topk(spark, d):
    m = read_model(spark, d)
    return R.top(m.graph_evidence(m.hits(MIXED_QUERY, V)).select(F.col("key").alias("evidence_id"), "score"), 40)


_SEM = T.driver_terms(MIXED_QUERY)


@query(f"with {EVL}, s as (select evidence_id, {S.signature()} as sig from evl), o as (select evidence_id, len(list_intersect(sig, {S.lit(_SEM)})) as c, len(sig) as n from s) select evidence_id, round(c / {len(_SEM)} + c / (n + {len(_SEM)} - c), 6) as score from o where c > 0 order by c / {len(_SEM)} + c / (n + {len(_SEM)} - c) desc, evidence_id limit 40", *EV)
def semantic_overlap_topk(spark, d):
    m = read_model(spark, d)
    return R.top(m.semantic(m.hits(MIXED_QUERY, V)).drop("key"), 40).select("evidence_id", r6("score").alias("score"))


_QV = T.driver_vector(_SEM)
_COS = "list_sum([a[1] * a[2] for a in list_zip(v, [" + ", ".join(map(repr, _QV)) + "])]) / sqrt(list_sum([y * y for y in v]))"


@query(f"with {EVL}, s as (select evidence_id, {S.overlap(MIXED_QUERY)} as o, {S.signature()} as sig from evl), c as (select evidence_id, o, {_COS.replace('(v,', '(v,')} as c from (select evidence_id, o, {S.raw_vector('sig')} as v from s where o > 0) z) select evidence_id, round(c + 0.05 * least(1, o / {len(_SEM)}), 6) as score from c where c > 1e-12 order by 2 desc, evidence_id limit 40", *EV)
def vector_cosine_topk(spark, d):
    m = read_model(spark, d)
    return R.top(m.vector(m.hits(MIXED_QUERY, V)).select("evidence_id", r6("score").alias("score")), 40)


@query("""with q as (select vec_id as q, embedding as a from embeddings where vec_id % 50 = 0), p as (select q, vec_id, label, list_cosine_similarity(a::double[], embedding::double[]) as s from q, embeddings where vec_id <> q),
  r as (select *, row_number() over (partition by q order by round(s, 9) desc, vec_id) as rank from p) select q, vec_id, rank::int as rank, round(s, 6) as score from r where rank <= 5""")
def embedding_knn(spark, d):
    """Five nearest by cosine of every fiftieth vector, against all vectors.

    Queries are a stated set, in blocks of 200 vectors: each row of a partition meets one block after the
    other, and the partition's five best go on, at every size in the same way."""
    e = view(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return R.nearest(e, e.where("vec_id % 50 = 0"), 5).select("q", "vec_id", F.col("rank").cast("int").alias("rank"), r6("s").alias("score"))


# --- facts as hits -------------------------------------------------------------------------------------


_SUPPORT = f"sup as (select fact_id, string_agg(coalesce(content, ''), chr(10) order by pos) as support from fact_evidence join evidence using (evidence_id) where evidence.created <= {V} and evidence.status in ('accepted', 'proposed') group by fact_id)"


def _path_sql(facts: str, text: str, words: list[str], extra: str = "") -> str:
    score = " + ".join(f"contains(lower(t), '{w}')::int" for w in words)
    return f"with {_SUPPORT}, p as (select f.fact_id, concat_ws(' ', {text}, support) as t from {facts} join sup using (fact_id) where f.status = 'accepted' and f.created <= {V} and f.valid_from <= {V} and (f.valid_until is null or f.valid_until >= {V}) {extra}) select fact_id, ({score})::double as score from p where ({score}) > 0"


def _score_words(words: list[str], text):
    return T.let(F.lower(text), lambda h: sum((F.when(h.contains(w), 1).otherwise(0) for w in words), F.lit(0))).cast("double")


def _paths(spark, d, facts: DataFrame, texts: list, words: list[str]) -> DataFrame:
    """(fact_id, score): how many words stand in a fact's text or in its visible evidence.

    Each evidence is searched once; what meets the facts is a mask of words, not texts."""
    mask = lambda c: sum((F.when(F.lower(c).contains(w), 1 << i).otherwise(0) for i, w in enumerate(words)), F.lit(0))
    ev = view(spark, d, "evidence").where(R.retrievable(V)).select("evidence_id", F.coalesce(mask(F.col("content")), F.lit(0)).alias("mask"))
    links = view(spark, d, "fact_evidence").select("fact_id", "evidence_id").join(ev, "evidence_id").groupBy("fact_id").agg(F.bit_or("mask").alias("mask"))
    x = facts.select("fact_id", mask(F.concat_ws(" ", *texts)).alias("own")).join(links, "fact_id")
    return x.select("fact_id", F.bit_count(F.col("own").bitwiseOR(F.col("mask"))).cast("double").alias("score")).where("score > 0")


def _ent(spark, d, key: str, label: str) -> DataFrame:
    return view(spark, d, "entities").select(F.col("entity_id").alias(key), F.col("label").alias(label))


def _accepted(spark, d, name: str) -> DataFrame:
    return view(spark, d, name).where(R.visible_at(V) & (F.col("status") == "accepted"))


@query(_path_sql("relations f join entities s on s.entity_id = f.src_id join entities o on o.entity_id = f.dst_id", "s.label, f.relation_type, o.label", ["located_in", "nation_3"]), "relations", "entities", "fact_evidence", "evidence")
def relation_path(spark, d):
    rel = _accepted(spark, d, "relations").join(_ent(spark, d, "src_id", "src"), "src_id").join(_ent(spark, d, "dst_id", "dst"), "dst_id")
    return _paths(spark, d, rel, ["src", "relation_type", "dst"], ["located_in", "nation_3"])


@query(_path_sql("claims f join entities s on s.entity_id = f.subject_id", "s.label, f.predicate, f.object", ["has_brand", "brand#7"]), "claims", "entities", "fact_evidence", "evidence")
def claim_path(spark, d):
    c = _accepted(spark, d, "claims").join(_ent(spark, d, "subject_id", "subject"), "subject_id")
    return _paths(spark, d, c, ["subject", "predicate", "object"], ["has_brand", "brand#7"])


@query(_path_sql("graph_events f join entities s on s.entity_id = f.entity_id", "f.event_type, f.occurred_at, s.label", ["order_f", "1997"]), "graph_events", "entities", "fact_evidence", "evidence")
def event_path(spark, d):
    e = _accepted(spark, d, "graph_events").join(_ent(spark, d, "entity_id", "who"), "entity_id")
    return _paths(spark, d, e, ["event_type", "occurred_at", "who"], ["order_f", "1997"])


TIME_QUERY = "when order_f as_of:1996-06 1995"


@query(f"select fact_id, occurred_at, (1 + contains(lower(concat_ws(' ', event_type, occurred_at)), 'order_f')::int)::double as score from graph_events where {VISIBLE} and status = 'accepted' and occurred_at <= '1996-06-31' and contains(occurred_at, '1995')", "graph_events")
def temporal_as_of(spark, d):
    assert R.wants_time(TIME_QUERY)
    e = _accepted(spark, d, "graph_events").where(R.temporal_filter(TIME_QUERY))
    return e.select("fact_id", "occurred_at", (1.0 + _score_words(["order_f"], F.concat_ws(" ", "event_type", "occurred_at"))).alias("score"))


@query(f"""with lab as (select source_scope, list_sort(list(distinct label)) as labels from evidence join evidence_entities using (evidence_id) join entities using (entity_id) where evidence.created <= {V} and evidence.status in ('accepted', 'proposed') group by 1),
  f as (select source_scope, kind, count(distinct fact_id) as n from facts join fact_evidence using (fact_id) join evidence using (evidence_id) where facts.status = 'accepted' and facts.created <= {V} and valid_from <= {V} and (valid_until is null or valid_until >= {V}) group by all)
  select source_scope, array_to_string(labels[1:12], ', ') as labels, coalesce(max(case when kind = 'relation' then n end), 0)::bigint as relations, coalesce(max(case when kind = 'claim' then n end), 0)::bigint as claims, coalesce(max(case when kind = 'event' then n end), 0)::bigint as events from lab left join f using (source_scope) group by all""", "evidence", "evidence_entities", "entities", "facts", "fact_evidence")
def community_summary(spark, d):
    ev = view(spark, d, "evidence").where(R.retrievable(V)).select("evidence_id", "source_scope")
    lab = ev.join(view(spark, d, "evidence_entities"), "evidence_id").join(view(spark, d, "entities"), "entity_id").groupBy("source_scope").agg(F.array_sort(F.collect_set("label")).alias("l"))
    n = fact_counts_by_scope(spark, d).groupBy("source_scope").agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k + "s") for k in ("relation", "claim", "event")])
    out = lab.join(n, "source_scope", "left")
    return out.select("source_scope", F.array_join(F.slice("l", 1, 12), ", ").alias("labels"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("relations", "claims", "events")])


# --- fusion, rerank, packs -----------------------------------------------------------------------------

LIMIT = 10
HYBRID_QUERY = "license overview NATION_3 when 1995"
_N = R.candidate_limit(LIMIT)
_LISTS = f"{EVL}, {S.hybrid(HYBRID_QUERY, V, _N, ['1995'])}"
_Q1 = T.driver_terms(HYBRID_QUERY, 1)
_COVER = lambda c: f"len(list_intersect({S.terms(c, 1)}, {S.lit(_Q1)})) / {len(_Q1)}"
_RERANK = f"""with {_LISTS}, rr as (select *, rrf + 0.40 * {_COVER('content')} + 0.25 * {_COVER("array_to_string(labels, ' ')")} + 0.20 * {_COVER("array_to_string(facts, ' ')")} + 0.05 * {_COVER('source_path')}
    + 0.05 * (len(sources) - 1) + case when len(facts) > 0 then 0.08 else 0 end as score from h)"""
_RV = (*EV, "relations", "claims", "graph_events", "facts", "fact_evidence")


def _hybrid(spark, d) -> tuple[DataFrame, DataFrame]:
    return RM.retrieve(read_model(spark, d), HYBRID_QUERY, LIMIT, V)


@query(f"with {_LISTS} select key, round(rrf, 6) as rrf, array_to_string(sources, ' ') as sources from fused", *_RV)
def rrf_fusion(spark, d):
    """All seven lists: words, evidence, semantic, vector, paths, time and communities."""
    return _hybrid(spark, d)[0].select("key", r6("rrf").alias("rrf"), F.array_join("sources", " ").alias("sources"))


@query(f"with {EVL}, {S.hybrid(HYBRID_QUERY, V, _N, ['1995'], 'bgptu')} select key, round(rrf, 6) as rrf, array_to_string(sources, ' ') as sources from fused", *_RV)
def graph_only_fusion(spark, d):
    """Without the lists that are switched off: what a plan that allows no derived sources gets."""
    x = RM.retrieve(read_model(spark, d), HYBRID_QUERY, LIMIT, V, without={"semantic", "vector"})[0]
    return x.select("key", r6("rrf").alias("rrf"), F.array_join("sources", " ").alias("sources"))


@query(f"""with {EVL}, {S.hybrid(HYBRID_QUERY, V, _N, ['1995'])} select key, fact_id, round(score, 6) as score from fs where score > 0 and kind = 'relation'""", *_RV)
def relation_paths_by_mask(spark, d):
    """Facts scored by the words of their own texts and of their evidence, from masks of small hits."""
    m = read_model(spark, d)
    x = m.graph_path(m.hits(HYBRID_QUERY, V), V).join(m.facts(V).where("kind = 'relation'").select("f", "fact_id"), "f")
    return x.select("key", "fact_id", r6("score").alias("score"))


@query("select 'ev:' || substr(sha256(length(source)::varchar || ':' || source || length(lang)::varchar || ':' || lang || length(text)::varchar || ':' || text), 1, 16) as evidence_id, 'entity:' || substr(sha256(length(trim(lang))::varchar || ':' || trim(lang)), 1, 16) as entity_id from documents where trim(text) <> ''")
def ingest_mapping(spark, d):
    """What an ingest request becomes: stable ids of evidence and entities, the same for the same row again."""
    rows = view(spark, d, "documents").where("trim(text) <> ''").select(F.col("source").alias("source_scope"), F.col("lang").alias("source_path"), F.col("text").alias("content"), F.array(F.concat(F.lit(" "), "lang")).alias("entity_labels"))
    return store.mutation_batch(rows)["evidence_entities"]


def _reranked(spark, d) -> DataFrame:
    return _hybrid(spark, d)[1]


@query(f"{_RERANK} select key, round(score, 6) as score, array_to_string(sources, ' ') as sources, array_to_string(labels, ' ') as labels, array_to_string(facts, '; ') as facts from rr", *_RV)
def rerank_score(spark, d):
    return _reranked(spark, d).select("key", r6("score").alias("score"), F.array_join("sources", " ").alias("sources"), F.array_join("labels", " ").alias("labels"), F.array_join("facts", "; ").alias("facts"))


@query(f"{_RERANK} select key, round(score, 6) as score, array_to_string(sources, ' ') as sources, array_to_string(labels, ' ') as labels, source_path from rr order by round(rr.score, 9) desc, key limit {LIMIT}", *_RV)
def hybrid_retrieval(spark, d):
    """The flagship: seven retrievers from the stored read model, fusion by reciprocal rank, deterministic rerank, the user's limit."""
    R.check_plan(HYBRID_QUERY, LIMIT)
    x = _reranked(spark, d).orderBy(F.desc(F.round("score", 9)), "key").limit(LIMIT)
    return x.select("key", r6("score").alias("score"), F.array_join("sources", " ").alias("sources"), F.array_join("labels", " ").alias("labels"), "source_path")


@query(f"{_RERANK}, p as (select key, strlen(content)::bigint as bytes, sum(strlen(content)) over (order by round(score, 9) desc, key rows unbounded preceding)::bigint as running from rr) select * from p where running <= 65536", *_RV)
def context_pack_budget(spark, d):
    x = R.byte_budget(_reranked(spark, d), 65536, [F.desc(F.round("score", 9)), F.asc("key")], F.octet_length("content"))
    return x.select("key", "bytes", "running")


@query(f"{_RERANK}, e as (select key as hit, unnest(labels) as label from rr) select label as node, count(*)::bigint as cited from e group by 1 union all select key, 1 from rr", *_RV)
def trace_nodes(spark, d):
    x = _reranked(spark, d)
    return x.select(F.explode("labels").alias("node")).groupBy("node").agg(F.count("*").alias("cited")).union(x.select("key", F.lit(1).cast("long")))


@query(f"{_RERANK} select key as src, unnest(labels) as dst, 'mentions' as edge from rr union all select key, unnest(facts), 'supports' from rr", *_RV)
def trace_edges(spark, d):
    x = _reranked(spark, d)
    return x.select(F.col("key").alias("src"), F.explode("labels").alias("dst"), F.lit("mentions").alias("edge")).union(x.select("key", F.explode("facts"), F.lit("supports")))


@query("select coalesce(parent_id, evidence_id) as key, count(*)::bigint as merged, strlen(string_agg(coalesce(content, ''), chr(10) order by evidence_id))::bigint as bytes, arg_min(source_path, evidence_id) as source_path from evidence where source_scope = 'chat' group by 1", "evidence")
def hit_merge(spark, d):
    """Children merged under their parent: contents in order, the first path."""
    ev = view(spark, d, "evidence").where("source_scope = 'chat'").withColumn("key", F.coalesce("parent_id", "evidence_id"))
    s = F.array_sort(F.collect_list(F.struct("evidence_id", F.coalesce("content", F.lit("")).alias("c"))))
    return ev.groupBy("key").agg(F.count("*").alias("merged"), F.octet_length(F.array_join(F.transform(s, lambda z: z["c"]), "\n")).cast("long").alias("bytes"), F.min_by("source_path", "evidence_id").alias("source_path"))


_NODES = "select entity_id as id, 'entity' as kind, case when length(label) <= 24 then label else concat(substr(label, 1, 23), '…') end as label from entities where entity_id not like 'customer:%' and entity_id not like 'part:%'"
_EDGES = f"select fact_id as id, src_id as src, dst_id as dst, relation_type as kind from relations where {VISIBLE}"


@query(f"select * from ({_NODES}) n order by id limit 600", "entities")
def graph_canvas_nodes(spark, d):
    shown = view(spark, d, "entities").where("entity_id not like 'customer:%' and entity_id not like 'part:%'")
    return shown.select(F.col("entity_id").alias("id"), F.lit("entity").alias("kind"), T.truncate_label(F.col("label"), 24).alias("label")).orderBy("id").limit(600)


@query(f"with n as (select id from ({_NODES}) x order by id limit 600) select e.* from ({_EDGES}) e where src in (select id from n) and dst in (select id from n) order by id limit 400", "entities", "relations")
def graph_canvas_edges(spark, d):
    """Edges whose two ends are both on the canvas."""
    n = graph_canvas_nodes(spark, d).select("id")
    e = view(spark, d, "relations").where(R.visible_at(V)).select(F.col("fact_id").alias("id"), F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.col("relation_type").alias("kind"))
    return e.join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi").select("id", "src", "dst", "kind").orderBy("id").limit(400)
