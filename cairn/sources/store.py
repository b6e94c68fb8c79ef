"""Versioned tables, file sources and scope maintenance: what the engine reads and writes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = {"evidence": ["evidence_id"], "entities": ["entity_id"], "relations": ["fact_id"], "claims": ["fact_id"], "graph_events": ["fact_id"], "evidence_entities": ["evidence_id", "entity_id"], "fact_evidence": ["fact_id", "pos"]}
SCHEMAS = {
    "evidence": "evidence_id string, source_scope string, source_path string, content string, created long, status string, parent_id string, modality string",
    "entities": "entity_id string, label string, created long",
    "evidence_entities": "evidence_id string, entity_id string",
    "relations": "fact_id string, src_id string, relation_type string, dst_id string, created long, valid_from long, valid_until long, status string, confidence int",
    "claims": "fact_id string, subject_id string, predicate string, object string, created long, valid_from long, valid_until long, status string, confidence int",
    "graph_events": "fact_id string, event_type string, occurred_at string, entity_id string, created long, valid_from long, valid_until long, status string, confidence int",
    "fact_evidence": "fact_id string, pos int, evidence_id string",
    "mutations": "graph_version long, n_evidence long, n_entities long, n_facts long, scopes array<string>",
}
MODALITIES = ["text_span", "image_asset", "ocr_text", "caption", "image_embedding", "table", "layout_region"]
STATUSES = ["proposed", "accepted", "rejected", "superseded"]


class StoreError(ValueError):
    pass


@dataclass
class GraphStore:
    """A knowledge graph in parquet: one folder for each table and version of it.

    A commit writes only what it changes: new rows go to ``<table>/v=<version>`` and a row of an older
    version with the same key is hidden by it (the newest version of a key counts). The mutation log is
    written last, and a version counts only if the log has it, so a commit that died leaves no trace."""

    spark: SparkSession
    path: str

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS["mutations"]).parquet(f"{self.path}/mutations")
        except Exception as e:  # no commit yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMAS["mutations"])

    def version(self) -> int:
        return self._log().agg(F.max("graph_version")).first()[0] or 0

    def read_after(self, version: int, limit: int = 128) -> DataFrame:
        """The change feed: mutations after a version."""
        return self._log().where(F.col("graph_version") > version).orderBy("graph_version").limit(limit)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a graph version: the newest row of each key."""
        v = self.version() if version is None else version
        try:
            every = self.spark.read.schema(SCHEMAS[name] + ", v long").parquet(f"{self.path}/{name}").where(F.col("v") <= v)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])
        cols = [c for c in every.columns if c not in (*KEYS[name], "v")]
        if not cols:
            return every.select(KEYS[name]).distinct()
        last = every.groupBy(KEYS[name]).agg(F.max_by(F.struct(*cols), "v").alias("r"))
        return last.select(*KEYS[name], "r.*").select([c.split()[0] for c in SCHEMAS[name].split(", ")])

    def commit(self, **tables: DataFrame) -> int:
        """Validates and upserts rows of the tables as one new version; returns it."""
        v = self.version() + 1
        rows = {}
        for name, df in tables.items():
            want = dict(c.split() for c in SCHEMAS[name].split(", "))
            have = set(df.columns)
            defaults = {"created": F.lit(v), "valid_from": F.lit(v), "status": F.lit("accepted"), "modality": F.lit("text_span"), "confidence": F.lit(10000)}
            rows[name] = df.select([F.coalesce(F.col(c), defaults.get(c, F.lit(None))).cast(t).alias(c) if c in have else defaults.get(c, F.lit(None)).cast(t).alias(c) for c, t in want.items()])
        self._validate(rows)
        for name, df in rows.items():
            # the folder's name is the version, so a repeated commit of the same version replaces itself
            df.dropDuplicates(KEYS[name]).write.mode("overwrite").parquet(f"{self.path}/{name}/v={v}")
        n = {k: (df.count() if k in rows else 0) for k, df in rows.items()}
        facts = sum(n.get(k, 0) for k in ("relations", "claims", "graph_events"))
        scopes = (rows["evidence"] if "evidence" in rows else self.spark.createDataFrame([], SCHEMAS["evidence"])).agg(F.array_sort(F.collect_set("source_scope")).alias("scopes"))
        log = scopes.select(*[F.lit(x).cast("long").alias(c) for c, x in (("graph_version", v), ("n_evidence", n.get("evidence", 0)), ("n_entities", n.get("entities", 0)), ("n_facts", facts))], "scopes")
        log.coalesce(1).write.mode("append").parquet(f"{self.path}/mutations")
        return v

    def _validate(self, rows: dict[str, DataFrame]) -> None:
        def none_of(df: DataFrame, why: str) -> None:
            if (bad := df.limit(1).collect()):
                raise StoreError(f"{why}: {bad[0].asDict()}")

        for name, df in rows.items():
            for k in KEYS[name]:
                none_of(df.where(F.col(k).isNull()), f"{name} without {k}")
            if "status" in df.columns:
                none_of(df.where(~F.col("status").isin(STATUSES)), "unknown status")
        if "evidence" in rows:
            ev = rows["evidence"]
            none_of(ev.where(~F.col("modality").isin(MODALITIES)), "unknown modality")
            parents = self.table("evidence").unionByName(ev).select(F.col("evidence_id").alias("parent_id"), F.col("source_scope").alias("ps"))
            child = ev.where("parent_id is not null").join(parents.dropDuplicates(["parent_id"]), "parent_id", "left")
            none_of(child.where("ps is null or ps <> source_scope"), "parent evidence is missing or in another scope")
        if "fact_evidence" in rows:
            known = self.table("evidence").select("evidence_id")
            known = known.union(rows["evidence"].select("evidence_id")) if "evidence" in rows else known
            none_of(missing_evidence(rows["fact_evidence"], known), "evidence that doesn't exist")

    def orphans(self) -> DataFrame:
        """Entities that nothing refers to."""
        return orphans(self.table)

    def inspect(self) -> DataFrame:
        each = [self.table(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("item"), "n") for t in KEYS]
        return reduce(DataFrame.union, each + [self._log().agg(F.count("*").alias("n")).select(F.lit("mutations").alias("item"), "n")])


REFERENCES = [("evidence_entities", "entity_id"), ("relations", "src_id"), ("relations", "dst_id"), ("claims", "subject_id"), ("graph_events", "entity_id")]


def orphans(table: Callable[[str], DataFrame]) -> DataFrame:
    """Entities that no evidence and no fact refers to, whatever gives the tables by name."""
    used = reduce(DataFrame.union, [table(t).select(F.col(c).alias("entity_id")) for t, c in REFERENCES]).distinct()
    return table("entities").join(used, "entity_id", "left_anti")


def missing_evidence(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Links of facts to evidence that doesn't exist."""
    return links.join(evidence.select("evidence_id"), "evidence_id", "left_anti")


def stable_id(prefix: str, *parts):
    """prefix:16 hex digits of the length-prefixed parts."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256), 1, 16))


def mutation_batch(requests: DataFrame) -> dict[str, DataFrame]:
    """Evidence, entities and their links of ingest rows (source_scope, content, entity_labels[, source_path, evidence_id]).

    Ids that are missing are made from scope, path and content, so the same row ingested again is the same evidence."""
    has = set(requests.columns)
    path = F.col("source_path") if "source_path" in has else F.lit(None).cast("string")
    made = stable_id("ev", F.col("source_scope"), F.coalesce(path, F.lit("")), F.col("content"))
    ev = requests.select(F.coalesce(F.col("evidence_id"), made).alias("evidence_id") if "evidence_id" in has else made.alias("evidence_id"), "source_scope", path.alias("source_path"), F.trim("content").alias("content"), F.transform(F.coalesce("entity_labels", F.array().cast("array<string>")), lambda x: F.trim(x)).alias("labels"))
    bad = ev.where("content is null or content = '' or source_scope is null").limit(1).collect()
    if bad:
        raise StoreError("evidence needs a scope and content")
    labels = ev.select("evidence_id", F.explode(F.array_distinct("labels")).alias("label")).where("label <> ''").withColumn("entity_id", stable_id("entity", F.col("label")))
    return {"evidence": ev.drop("labels"), "entities": labels.select("entity_id", "label").dropDuplicates(["entity_id"]), "evidence_entities": labels.select("evidence_id", "entity_id")}


# --- files ---------------------------------------------------------------------------------------------

IGNORED = r"(^|/)(\.git|node_modules|target|\.venv|__pycache__)/"


def read_files(spark: SparkSession, root: str, scope: str = "files", max_bytes: int | None = None) -> DataFrame:
    """(scope, file_id, path, content, byte_len, blob_hash, mtime) of a folder's files, but for ignored folders; of files up to ``max_bytes`` only where that is given."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    raw = raw if max_bytes is None else raw.where(F.col("length") <= max_bytes)
    base = root.removeprefix("file://").rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + base.replace("\\", "\\\\").replace(".", r"\."), "")
    text = F.decode("content", "UTF-8")
    return raw.select(F.lit(scope).alias("scope"), path.alias("path"), text.alias("content"), F.col("length").alias("byte_len"), F.sha1("content").alias("blob_hash"), F.col("modificationTime").alias("mtime")).where(~F.col("path").rlike(IGNORED)).withColumn("file_id", stable_id("file", F.col("scope"), F.col("path")))


def fingerprints(files: DataFrame) -> DataFrame:
    return files.select("path", "blob_hash")


def diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(path, change, old_path): added, deleted, modified or renamed (the same content elsewhere) paths."""
    b, h = base.select("path", F.col("blob_hash").alias("old")), head.select("path", F.col("blob_hash").alias("new"))
    x = b.join(h, "path", "full_outer").where("old is null or new is null or old <> new")
    gone = x.where("new is null").groupBy(F.col("old").alias("new")).agg(F.min("path").alias("old_path"))
    change = F.when(F.col("old_path").isNotNull(), "renamed").when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified")
    return x.join(gone, "new", "left").select("path", change.alias("change"), "old_path")


def overlay(base: DataFrame, changed: DataFrame, rows: DataFrame) -> DataFrame:
    """base rows of unchanged paths and the new rows of changed ones."""
    return base.join(changed.select("path").distinct(), "path", "left_anti").unionByName(rows)


def file_index(existing: DataFrame, observed: DataFrame, complete: bool) -> DataFrame:
    """(path, byte_len, status): seen files are indexed; unseen ones become missing only if the scan was complete."""
    e = existing.select("path", F.col("byte_len").alias("old"), F.col("status").alias("was"))
    x = e.join(observed.select("path", "byte_len"), "path", "full_outer")
    status = F.when(F.col("byte_len").isNotNull(), "indexed").when(F.lit(complete), "missing").otherwise(F.col("was"))
    return x.select("path", F.coalesce("byte_len", "old").alias("byte_len"), status.alias("status"))


def batches(files: DataFrame, most_files: int = 512, most_bytes: int = 16 << 20) -> DataFrame:
    """Files with a batch number whose files and bytes are bounded, path by path; Spark itself needs no such plan."""
    from pyspark.sql import Window

    w = Window.partitionBy("scope").orderBy("path")
    x = files.withColumn("_n", F.row_number().over(w) - 1).withColumn("_b", F.sum("byte_len").over(w) - F.col("byte_len"))
    return x.withColumn("batch", F.greatest(F.floor(F.col("_n") / most_files), F.floor(F.col("_b") / most_bytes))).drop("_n", "_b")


def replace_scopes(df: DataFrame, path: str) -> None:
    """A snapshot sink: only the scopes that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope").parquet(path)


def import_tables(spark: SparkSession, source: str, target: str, names: list[str], scope: str | None = None) -> None:
    """Copies tables of another store, all scopes or one."""
    for n in names:
        df = spark.read.parquet(f"{source}/{n}")
        replace_scopes(df.where(F.col("scope") == scope) if scope else df, f"{target}/{n}")
