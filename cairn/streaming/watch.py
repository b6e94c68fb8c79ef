"""Structured Streaming forms of the change watcher: filter, debounce, content-hash dedupe, fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources.scratch import scratch

IGNORED = ["node_modules", ".git", "target", "dist", "build", ".venv"]


def should_process(path, languages: list[str] | None = None):
    """A known language, outside ignored folders."""
    lang = P.language(path)
    out = lang.isNotNull() & ~path.rlike(r"(^|/)(" + "|".join(x.replace(".", r"\.") for x in IGNORED) + r")/")
    return out & lang.isin(languages) if languages else out


def debounced(changes: DataFrame, ts: str = "ts", path: str = "path", quiet: str = "3 seconds", late: str = "10 seconds", scope: str | None = None) -> DataFrame:
    """Sets of changed paths: an event-time session closes after ``quiet``; events later than ``late`` are dropped by the watermark.

    One session is over all paths of a ``scope``, if there is such a column (sessions of scopes are then
    kept apart, each by its own task), else over all paths there are."""
    kept = changes.where(should_process(F.col(path))).withWatermark(ts, late)
    # a streamed session needs a key, and one that isn't a literal
    kept = kept.withColumn("_scope", F.col(scope) if scope else F.substring(path, 1, 0))
    named = [F.col("_scope").alias(scope)] if scope else []
    return kept.groupBy("_scope", F.session_window(ts, quiet).alias("w")).agg(F.collect_set(path).alias("paths")).select(*named, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "paths")


def new_contents(changes: DataFrame, key: str = "path", value: str = "hash", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Changes whose (path, hash) wasn't seen within the watermark; state is bounded by it."""
    return changes.withWatermark(ts, late).dropDuplicatesWithinWatermark([key, value])


def run_available(spark: SparkSession, path: str, target: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Folds all files of an events folder by user, in micro-batches, and returns the final state.

    The stream keeps only (count, kinds, first id) for each user. Each micro-batch writes the state as a
    table of its own number, and offsets and state are checkpointed, both in the shared folder where no
    places are given: a stream restarted with the same places goes on where it was."""
    schema = spark.read.parquet(path).schema
    source = path if not path.endswith(".parquet") else path + "*"
    target, checkpoint = target or scratch(spark, "activity"), checkpoint or scratch(spark, "offsets")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).option("recursiveFileLookup", "true").parquet(source)
    folded = stream.where("event_type <> 'error'").groupBy("user_id").agg(F.count("*").alias("events"), F.size(F.collect_set("event_type")).cast("long").alias("kinds"), F.min("event_id").alias("first"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    folded.writeStream.foreachBatch(apply).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema(folded.schema.add("batch", "long")).parquet(target)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == last).drop("batch")


def refresh_into(stream: DataFrame, target: str, checkpoint: str, keys: list[str]):
    """Idempotent batch sink: each micro-batch goes to a folder of its own id, so a replay overwrites itself."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)
