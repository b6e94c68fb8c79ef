"""Registered queries of logs, queues, cursors, sessions and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import state as St
from ..sources import adapter
from ..streaming import watch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The events table as logs: event ids are versions, types are what happened.
VIEWS = {
    "mutations": "select event_id as graph_version, event_type as kind, user_id as entity, value from events",
    "cursors": "select concat(kind, ':', cast(entity % 10 as varchar(20))) as cursor_id, kind, max(graph_version) as indexed_version from mutations where graph_version % 3 <> 0 group by concat(kind, ':', cast(entity % 10 as varchar(20))), kind",
    "tasks": "select event_id as task_id, case event_type when 'click' then 'queued' when 'view' then 'running' when 'error' then 'retrying' when 'signup' then 'succeeded' else 'running' end as state, cast(1 + event_id % 4 as int) as attempts, event_id * 10 % 7919 as created_ms, event_id % 50 as target_version, cast(user_id * 40 as bigint) as next_retry_ms, cast(user_id * 50 as bigint) as lease_until_ms from events",
    "proposals": "select user_id as proposal_id, event_id as seq, case event_type when 'click' then 'accepted' when 'error' then 'rejected' when 'signup' then 'superseded' else 'proposed' end as state from events",
}


def view(spark, d, name) -> DataFrame:
    return adapter.view(spark, d, name, VIEWS)


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = adapter.with_views(sql, *views, views=VIEWS)
        return f

    return register


NOW = 4000
_RECOVERED = f"""r as (select task_id, case when state = 'running' and lease_until_ms < {NOW} then case when attempts >= 3 then 'dead_letter' else 'retrying' end else state end as state, attempts, created_ms, target_version, case when state = 'running' and lease_until_ms < {NOW} then {NOW} else next_retry_ms end as next_retry_ms from tasks)"""


@query("select graph_version, kind, entity from mutations where graph_version > 500 order by graph_version limit 128", "mutations")
def mutation_log_after(spark, d):
    return St.read_after(view(spark, d, "mutations").select("graph_version", "kind", "entity"), 500, 128)


@query("select cursor_id, indexed_version, (select max(graph_version) from mutations) - indexed_version as lag, case when (select max(graph_version) from mutations) > indexed_version then 'stale' else 'fresh' end as state from cursors", "cursors", "mutations")
def cursor_lag(spark, d):
    top = view(spark, d, "mutations").agg(F.max("graph_version")).first()[0] or 0
    return St.lag_of(view(spark, d, "cursors").select("cursor_id", "indexed_version"), top)


@query("select distinct concat(kind, ':', cast(entity % 12 as varchar)) as cursor_id from mutations where concat(kind, ':', cast(entity % 12 as varchar)) not in (select cursor_id from cursors)", "mutations", "cursors")
def missing_cursors(spark, d):
    m = view(spark, d, "mutations").select(F.concat("kind", F.lit(":"), (F.col("entity") % 12).cast("string")).alias("cursor_id")).distinct()
    return m.join(view(spark, d, "cursors").select("cursor_id"), "cursor_id", "left_anti")


@query(f"with {_RECOVERED} select task_id, created_ms, target_version from r where (state = 'queued' or (state = 'retrying' and next_retry_ms <= {NOW})) and attempts < 3 order by created_ms, target_version, task_id limit 50", "tasks")
def task_claim_order(spark, d):
    return St.claim(view(spark, d, "tasks"), NOW, 50).select("task_id", "created_ms", "target_version")


@query(f"with {_RECOVERED} select state, count(*)::bigint as n, min(created_ms)::bigint as oldest, max(next_retry_ms)::bigint as latest_retry from r group by state", "tasks")
def lease_recovery(spark, d):
    return St.recover(view(spark, d, "tasks"), NOW).groupBy("state").agg(F.count("*").alias("n"), F.min("created_ms").alias("oldest"), F.max("next_retry_ms").alias("latest_retry"))


@query(f"with {_RECOVERED} select target_version, count(*) filter (state = 'dead_letter')::bigint as dead, count(*) filter (state = 'retrying')::bigint as retrying from r group by 1", "tasks")
def dead_letter_counts(spark, d):
    c = lambda s: F.count_if(F.col("state") == s)
    return St.recover(view(spark, d, "tasks"), NOW).groupBy("target_version").agg(c("dead_letter").alias("dead"), c("retrying").alias("retrying"))


@query("select task_id, case when attempts >= 3 then 'dead_letter' else 'retrying' end as on_failure, case when attempts >= 3 then null else created_ms + 250 end as next_retry_ms, case when target_version > 40 then 'queued' else 'succeeded' end as on_success from tasks where state = 'running'", "tasks")
def task_state_fold(spark, d):
    t = view(spark, d, "tasks").where("state = 'running'").withColumn("f", St.after_failure(F.col("attempts"), F.col("created_ms")))
    return t.select("task_id", F.col("f.state").alias("on_failure"), F.col("f.next_retry_ms").alias("next_retry_ms"), St.after_success(F.col("target_version") > 40).alias("on_success"))


@query("select proposal_id, arg_min(state, seq) filter (state <> 'proposed') as decision, max(seq) as last_seq, count(*) filter (state <> 'proposed')::bigint as decisions from proposals group by proposal_id", "proposals")
def proposal_latest_state(spark, d):
    return St.decisions(view(spark, d, "proposals")).withColumnRenamed("last", "last_seq")


@query("select event_id, user_id, value from events where event_type = 'error' order by event_id desc limit 100")
def audit_topk(spark, d):
    return St.audit(view(spark, d, "events").where("event_type = 'error'"), "event_id", 100).select("event_id", "user_id", "value")


@query("select event_type, count(*)::bigint as n, sum(json_extract(props, '$.k')::bigint)::bigint as k from events group by 1")
def json_properties(spark, d):
    return view(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("""with l as (select user_id, event_type, ts, lag(ts) over (partition by user_id order by ts) as before from events), s as (select *, sum(case when before is null or ts >= before + interval 1 hour then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as n from l)
  select user_id, min(ts) as started, count(*)::bigint as changes, count(distinct event_type)::bigint as paths from s group by user_id, n""")
def debounce_sessions(spark, d):
    """The batch twin of the debounced stream: session windows by user."""
    x = St.sessions(view(spark, d, "events"), "ts", "1 hour", "user_id").agg(F.min("ts").alias("started"), F.count("*").alias("changes"), F.count_distinct("event_type").alias("paths"))
    return x.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "changes", "paths")


@query("select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) x where before is null or before <> event_type")
def hash_change_dedupe(spark, d):
    return St.changed_hashes(view(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", ["ts", "event_id"], "event_type").drop("ts")


@query("select user_id, count(*)::bigint as events, count(distinct event_type)::bigint as kinds, min(event_id) as first from events where event_type <> 'error' group by user_id")
def streamed_activity(spark, d):
    """A file stream of the events table, filtered and folded, run until nothing is left."""
    return watch.run_available(spark, f"{d}/events.parquet")


@query("select graph_version // 1000 as page, count(*)::bigint as n, count(distinct entity)::bigint as entities from mutations where graph_version > 200 group by 1", "mutations")
def mutation_replay(spark, d):
    return St.replay(view(spark, d, "mutations"), 200, 1000)


@query("select user_id as id, event_type as kind, max(event_id) as version from events where not (event_id % 4 = 0 and event_type = 'view') group by all")
def graph_upsert(spark, d):
    """The sink's merge: new rows in place of old ones with the same key."""
    e = view(spark, d, "events").where("not (event_id % 4 = 0 and event_type = 'view')").select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), F.col("event_id").alias("version"))
    old = St.latest(e.where("version % 2 = 0"), ["id", "kind"], ["version"])
    new = St.latest(e, ["id", "kind"], ["version"])
    return St.upsert(old, new, ["id", "kind"])


@query("select scope, repository, version from (select event_id as scope, user_id as repository, event_id as version, row_number() over (partition by user_id order by event_id desc) as r from events) x where r > 3 and scope % 100 <> 0")
def retention_prune(spark, d):
    s = view(spark, d, "events").select(F.col("event_id").alias("scope"), F.col("user_id").alias("repository"), F.col("event_id").alias("version"))
    return St.keep_scopes(s, 3, s.where("scope % 100 = 0")).select("scope", "repository", "version")


# --- evaluation ----------------------------------------------------------------------------------------

_PREDICTED = "p as (select doc_id, quality, toxic, row_number() over (order by hash, doc_id) as rank from (select doc_id, quality, toxic, (doc_id * 7919 % 1009) as hash from labels) z)"


@query("select toxic, count(*)::bigint as cases, count(*) filter (found)::bigint as passed, count(*) filter (not found)::bigint as failed, count(*) filter (forbidden)::bigint as forbidden from (select toxic, doc_id % 3 <> 0 as found, quality = 0 and doc_id % 2 = 0 as forbidden from labels) x group by toxic")
def evaluation_cases(spark, d):
    x = view(spark, d, "labels").select("toxic", (F.col("doc_id") % 3 != 0).alias("found"), ((F.col("quality") == 0) & (F.col("doc_id") % 2 == 0)).alias("forbidden"))
    return x.groupBy("toxic").agg(F.count("*").alias("cases"), F.count_if("found").alias("passed"), F.count_if(~F.col("found")).alias("failed"), F.count_if("forbidden").alias("forbidden"))


@query("""with c as (select doc_id % 20 as case_id, doc_id, quality, toxic, row_number() over (partition by doc_id % 20 order by doc_id * 7919 % 1009, doc_id) as rank from labels), t as (select * from c where rank <= 20)
  select case_id, round(coalesce(max(case when quality = 1 then 1.0::double / rank end), 0), 6) as reciprocal_rank, round(count(*) filter (quality = 1) / count(*)::double, 6) as coverage, round(least(0.5, 0.1 * count(*) filter (toxic = 1))::double, 6) as forbidden_penalty from t group by case_id""")
def ranked_metrics(spark, d):
    """Reciprocal rank of the first expected hit, coverage, and a capped penalty for forbidden ones."""
    w = Window.partitionBy("case_id").orderBy(F.col("doc_id") * 7919 % 1009, "doc_id")
    c = view(spark, d, "labels").withColumn("case_id", F.col("doc_id") % 20).withColumn("rank", F.row_number().over(w)).where("rank <= 20")
    r = F.coalesce(F.max(F.when(F.col("quality") == 1, F.lit(1.0) / F.col("rank"))), F.lit(0.0))
    return c.groupBy("case_id").agg(F.round(r, 6).alias("reciprocal_rank"), F.round(F.count_if(F.col("quality") == 1) / F.count("*"), 6).alias("coverage"), F.round(F.least(F.lit(0.5), F.lit(0.1) * F.count_if(F.col("toxic") == 1)), 6).alias("forbidden_penalty"))


@query("""with c as (select doc_id % 20 as case_id, doc_id, row_number() over (partition by doc_id % 20 order by doc_id * 7919 % 1009, doc_id) as rank from labels), l as (select case_id, rank, lead(doc_id) over (partition by case_id order by rank) > doc_id as ordered from c where rank <= 20)
  select case_id, count(*) filter (ordered)::bigint as ordered_pairs, count(ordered)::bigint as pairs from l group by case_id""")
def sequence_quality(spark, d):
    """Adjacent expected hits that stand in the expected order."""
    w = Window.partitionBy("case_id").orderBy(F.col("doc_id") * 7919 % 1009, "doc_id")
    c = view(spark, d, "labels").select((F.col("doc_id") % 20).alias("case_id"), "doc_id").withColumn("rank", F.row_number().over(w)).where("rank <= 20")
    c = c.withColumn("ordered", F.lead("doc_id").over(Window.partitionBy("case_id").orderBy("rank")) > F.col("doc_id"))
    return c.groupBy("case_id").agg(F.count_if("ordered").alias("ordered_pairs"), F.count("ordered").alias("pairs"))


@query("select date_trunc('hour', ts) as period, count(*)::bigint as received, least(12, count(*))::bigint as admitted, greatest(0, count(*) - 12)::bigint as dropped from events group by 1")
def channel_overflow(spark, d):
    return St.admitted(view(spark, d, "events"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), 12)


@query("select event_id, class, case when r <= case class when 'view' then 40 when 'click' then 25 else 60 end then 'admitted' else 'rejected' end as admission from (select *, row_number() over (partition by class order by event_id) as r from (select event_id, case when event_type in ('view', 'click') then event_type else 'other' end as class from events) a) b")
def qos_admission(spark, d):
    """Each class of requests has room for so many; the others share theirs."""
    x = view(spark, d, "events").select("event_id", F.col("event_type").alias("kind"))
    return St.admit(x, {"view": 40, "click": 25, "other": 60}, order="event_id").select("event_id", "class", "admission")


@query("select kind, state, count(*)::bigint as depth, min(created_ms)::bigint as oldest from (select event_type as kind, state, created_ms from tasks join events on event_id = task_id) x where state in ('queued', 'running', 'retrying') group by all", "tasks")
def worker_queue_depth(spark, d):
    k = view(spark, d, "events").select(F.col("event_id").alias("task_id"), F.col("event_type").alias("kind"))
    t = view(spark, d, "tasks").join(k, "task_id").where(F.col("state").isin("queued", "running", "retrying"))
    return t.groupBy("kind", "state").agg(F.count("*").alias("depth"), F.min("created_ms").alias("oldest"))


@query(f"with {_RECOVERED} select kind, task_id from (select user_id % 4 as kind, task_id, row_number() over (partition by user_id % 4 order by created_ms, task_id) as n from r join events on event_id = task_id where (state = 'queued' or (state = 'retrying' and next_retry_ms <= {NOW})) and attempts < 3) x where n <= 2", "tasks")
def worker_claims(spark, d):
    """The two oldest claimable tasks of each kind of worker; expired leases can be claimed."""
    k = view(spark, d, "events").select(F.col("event_id").alias("task_id"), (F.col("user_id") % 4).alias("kind"))
    return St.claim_each(view(spark, d, "tasks").join(k, "task_id"), NOW, "kind", 2).select("kind", "task_id")
