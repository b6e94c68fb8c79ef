"""Mutation logs, cursors, leased queues, proposals and audit logs, as folds over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEASE_MS, RETRY_MS, MAX_ATTEMPTS = 30_000, 250, 3


def read_after(log: DataFrame, version: int, limit: int) -> DataFrame:
    """Mutations after a version, in order."""
    return log.where(F.col("graph_version") > version).orderBy("graph_version").limit(limit)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)


def latest(events: DataFrame, keys: list[str], order: list[str], *columns: str) -> DataFrame:
    """The last event of each key: a max over structs, pre-aggregated before the shuffle."""
    return events.groupBy(keys).agg(F.max(F.struct(*order, *columns)).alias("l")).select(*keys, "l.*")


def lag_of(cursors: DataFrame, current: int) -> DataFrame:
    return cursors.withColumn("lag", F.lit(current) - F.col("indexed_version")).withColumn("state", F.when(F.col("lag") > 0, "stale").otherwise("fresh"))


def eligible(now: int) -> Column:
    """Queued, or retrying and due."""
    return (F.col("state") == "queued") | ((F.col("state") == "retrying") & (F.col("next_retry_ms") <= now))


def recover(tasks: DataFrame, now: int) -> DataFrame:
    """Expired leases: retry, or dead letters at the last attempt."""
    gone = (F.col("state") == "running") & (F.col("lease_until_ms") < now)
    state = F.when(gone & (F.col("attempts") >= MAX_ATTEMPTS), "dead_letter").when(gone, "retrying").otherwise(F.col("state"))
    return tasks.withColumns({"state": state, "next_retry_ms": F.when(gone, F.lit(now).cast("long")).otherwise(F.col("next_retry_ms"))})


def claim(tasks: DataFrame, now: int, n: int = 1) -> DataFrame:
    """The oldest eligible tasks, after recovery: by creation, version, id."""
    return recover(tasks, now).where(eligible(now) & (F.col("attempts") < MAX_ATTEMPTS)).orderBy("created_ms", "target_version", "task_id").limit(n)


def claim_each(tasks: DataFrame, now: int, kind: str, n: int = 1) -> DataFrame:
    """The oldest claimable tasks of each kind of worker; expired leases are recovered first."""
    w = Window.partitionBy(kind).orderBy("created_ms", "task_id")
    ready = recover(tasks, now).where(eligible(now) & (F.col("attempts") < MAX_ATTEMPTS))
    return ready.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def decisions(events: DataFrame, key: str = "proposal_id", order: str = "seq") -> DataFrame:
    """(key, decision, last, decisions): only a proposed one can be decided, so the first decision stands and later ones are conflicts."""
    decided = F.col("state") != "proposed"
    x = events.groupBy(key).agg(F.min(F.when(decided, F.struct(order, "state"))).alias("m"), F.max(order).alias("last"), F.count_if(decided).alias("decisions"))
    return x.select(key, F.col("m.state").alias("decision"), "last", "decisions")


def audit(events: DataFrame, order: str, limit: int) -> DataFrame:
    """The newest entries of an audit log."""
    return events.orderBy(F.desc(order)).limit(limit)


def replay(log: DataFrame, after: int, page: int) -> DataFrame:
    """(page, n, entities): what is to be replayed after a version, page by page."""
    later = log.where(F.col("graph_version") > after)
    return later.groupBy(F.expr(f"graph_version div {page}").alias("page")).agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"))


def admitted(arrivals: DataFrame, period: Column, capacity: int) -> DataFrame:
    """(period, received, admitted, dropped): a bounded channel doesn't block, it counts what it can't take."""
    x = arrivals.groupBy(period.alias("period")).agg(F.count("*").alias("received"))
    return x.select("period", "received", F.least(F.lit(capacity), F.col("received")).alias("admitted"), F.greatest(F.lit(0), F.col("received") - capacity).alias("dropped"))


def admit(requests: DataFrame, limits: dict[str, int], kind: str = "kind", order: str = "arrived") -> DataFrame:
    """Requests with their admission: each class takes so many in order of arrival, what has no class of its own shares ``other``."""
    of = F.when(F.col(kind).isin([k for k in limits if k != "other"]), F.col(kind)).otherwise("other")
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    x = requests.withColumn("class", of).withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(order)))
    return x.withColumn("admission", F.when(F.col("place") <= F.element_at(most, F.col("class")), "admitted").otherwise("rejected"))


def after_failure(attempts: Column, now: Column) -> Column:
    return F.when(attempts >= MAX_ATTEMPTS, F.struct(F.lit("dead_letter").alias("state"), F.lit(None).cast("long").alias("next_retry_ms"))).otherwise(F.struct(F.lit("retrying").alias("state"), (now + RETRY_MS).alias("next_retry_ms")))


def after_success(newer: Column) -> Column:
    """Done, unless a newer mutation or target came meanwhile: then queued afresh."""
    return F.when(newer, "queued").otherwise("succeeded")


def sessions(events: DataFrame, ts: str, gap: str = "3 seconds", *keys: str) -> DataFrame:
    """Debounced change sets: a session ends when nothing came for ``gap``."""
    return events.groupBy(*keys, F.session_window(ts, gap).alias("w"))


def changed_hashes(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Events whose content differs from the one before of the same key; the first counts as changed."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("_before", F.lag(value).over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def keep_scopes(scopes: DataFrame, recent: int, in_use: DataFrame) -> DataFrame:
    """Scopes to prune: neither among the recent successes of their repository nor in use."""
    w = Window.partitionBy("repository").orderBy(F.desc("version"), "scope")
    kept = scopes.withColumn("r", F.row_number().over(w)).where(F.col("r") <= recent).select("scope").union(in_use.select("scope")).distinct()
    return scopes.join(kept, "scope", "left_anti")
