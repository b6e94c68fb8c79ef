"""Projections of software facts: topics, effective build models, targets, deployment resources, knowledge maps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapter import by_keys
from ..sources.scratch import cut, drop


def topics(files: DataFrame) -> DataFrame:
    """(path, level, topic, line) of markdown headings."""
    lines = files.where(F.col("path").rlike(r"(?i)\.md$")).select("path", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    head = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
    return lines.where(F.col("text").rlike(head)).select("path", F.length(F.regexp_extract("text", head, 1)).alias("level"), F.regexp_extract("text", head, 2).alias("topic"), (F.col("n") + 1).alias("line"))


def effective_models(projects: DataFrame, properties: DataFrame, managed: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Build models with what they inherit: (project, artifact, version).

    projects (project, parent), properties (project, name, value), managed and dependencies (project,
    artifact, version, null where inherited). The nearest ancestor that says anything wins; a version of
    the form ${name} is looked up in the nearest property. What is said is handed down by joins whose reach doubles
    each round, a row for each project and key, so chains of any length take few rounds and no ancestor is listed; in
    a cycle of parents each project is an ancestor once."""
    null = lambda kind: F.lit(None).cast(kind)
    artifact = dependencies.select("artifact").distinct()
    rows = lambda df, what, key, value: df.select(F.lit(what).alias("what"), F.col("project"), F.col(key).alias("key"), F.col(value).cast("string").alias("value"))
    listed = by_keys(projects.select("project").distinct())
    said = rows(dependencies, "own", "artifact", "version").union(rows(managed.join(by_keys(artifact), "artifact", "left_semi"), "managed", "artifact", "version").where("value is not null")).union(rows(properties, "property", "name", "value")).join(listed, "project", "left_semi")
    # d: how far up the nearest project that says a value is; a dependency without a version is known, at no distance
    near = lambda x: x.groupBy("what", "project", "key").agg(F.min_by("value", "d").alias("value"), F.min("d").alias("d"))
    known = cut(near(said.withColumn("d", F.when((F.col("what") == "property") | F.col("value").isNotNull(), F.lit(0).cast("long")).otherwise(null("long")))), "said")
    jump = cut(projects.where("parent is not null").select("project", F.col("parent").alias("to")).distinct(), "parents")
    size = lambda df: df.agg(F.count("*"), F.count("d")).first()
    step, n = 1, size(known)
    while not jump.isEmpty():
        beyond = known.withColumnRenamed("project", "to").join(by_keys(jump), "to").select("what", "project", "key", "value", (F.col("d") + step).alias("d"))
        old, known = known, cut(near(known.union(beyond)), "said")
        before, n = n, size(known)
        drop(old)
        if n == before:  # a value that is yet to come from further up would first have come to a project in between
            break
        old, jump = jump, cut(jump.join(by_keys(jump.select(F.col("project").alias("to"), F.col("to").alias("next"))), "to").select("project", F.col("next").alias("to")).distinct(), "parents")
        drop(old)
        step *= 2
    of = lambda what, key, value: known.where(F.col("what") == what).select("project", F.col("key").alias(key), F.col("value").alias(value))
    x = of("own", "artifact", "own").join(by_keys(of("managed", "artifact", "value")), ["project", "artifact"], "left").select("project", "artifact", F.coalesce("own", "value").alias("raw"))
    x = x.withColumn("name", F.nullif(F.regexp_extract(F.coalesce("raw", F.lit("")), r"^\$\{(.+)\}$", 1), F.lit("")))
    return x.join(by_keys(of("property", "name", "value")), ["project", "name"], "left").select("project", "artifact", F.when(F.col("name").isNotNull(), F.col("value")).otherwise(F.col("raw")).alias("version"))


_TARGETS = [
    (r"(^|/)Cargo\.toml$", "cargo", r"(?m)^\[\[?(bin|lib|test|bench)\]?\]"),
    (r"(^|/)package\.json$", "npm", r"\"(build|test|start|lint)\"\s*:"),
    (r"(^|/)pyproject\.toml$", "pyproject", r"(?m)^\[(project|build-system)\]"),
    (r"(^|/)go\.mod$", "go", r"(?m)^module\s+(\S+)"),
    (r"(^|/)CMakeLists\.txt$", "cmake", r"add_(?:executable|library)\(\s*(\w+)"),
    (r"(^|/)Makefile$", "make", r"(?m)^([A-Za-z][\w-]*):(?!=)"),
    (r"(^|/)build\.gradle(\.kts)?$", "gradle", r"(?m)task\s+(\w+)"),
    (r"\.github/workflows/.*\.ya?ml$|(^|/)\.gitlab-ci\.yml$", "ci", r"(?m)^\s{2}([\w-]+):\s*$"),
]
_RESOURCES = [
    (r"(^|/)Dockerfile", "docker", r"(?m)^FROM\s+(\S+)"),
    (r"\.tf$", "terraform", r"resource\s+\"[\w-]+\"\s+\"([\w-]+)\""),
    (r"\.service$", "systemd", r"(?m)^ExecStart=(\S+)"),
    (r"(^|/)(docker-)?compose\.ya?ml$", "compose", r"(?m)^\s{2}([\w-]+):\s*$"),
    (r"(^|/)Chart\.yaml$", "helm", r"(?m)^name:\s*(\S+)"),
    (r"\.ya?ml$", "kubernetes", r"(?m)^kind:\s*(\w+)"),
]


def _by_rules(files: DataFrame, rules) -> DataFrame:
    """The first rule whose path fits names the kind; each match of its pattern is a row."""
    kind, names = F.lit(None).cast("string"), F.array().cast("array<string>")
    for path, k, pattern in reversed(rules):
        fits = F.col("path").rlike(path)
        kind = F.when(fits, k).otherwise(kind)
        names = F.when(fits, F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).otherwise(names)
    return files.select("path", kind.alias("kind"), F.explode(F.array_distinct(names)).alias("name"))


def build_targets(files: DataFrame) -> DataFrame:
    return _by_rules(files, _TARGETS)


def deployment_resources(files: DataFrame) -> DataFrame:
    return _by_rules(files, _RESOURCES)


def design_elements(files: DataFrame) -> DataFrame:
    """Decision records and interface contracts: (path, kind, name)."""
    return _by_rules(files, [(r"(?i)(^|/)adr[s]?/.*\.md$", "decision", r"(?m)^#\s+(.+)$"), (r"\.proto$", "service", r"(?m)^service\s+(\w+)"), (r"(?i)openapi.*\.ya?ml$", "endpoint", r"(?m)^\s{2}(/\S*):\s*$")])


def route_topic(topic_sources: DataFrame, sources: DataFrame, topic: str) -> DataFrame:
    """A knowledge map's sources of a topic, in their order: topic_sources has (topic, source_order array)."""
    want = topic_sources.where(F.lower("topic") == topic.strip().lower()).select(F.posexplode("source_order").alias("position", "source_id"))
    return want.join(sources, "source_id").orderBy("position")


def usages(components: DataFrame, imports: DataFrame) -> DataFrame:
    """(package_name, module, confidence): imports that name a dependency, by aliases of its ecosystem; the weaker side's confidence."""
    alias = F.when(F.col("ecosystem") == "cargo", F.array(F.regexp_replace("package_name", "-", "_"))).when(F.col("ecosystem") == "python", F.array(F.lower(F.regexp_replace("package_name", "-", "_")), F.lower("package_name"))).otherwise(F.array("package_name"))
    c = components.select("package_name", F.col("confidence").alias("cc"), F.explode(F.array_distinct(alias)).alias("key"))
    root = F.split(F.regexp_replace("module", "::", "/"), r"[/.]")
    keys = F.array_distinct(F.array(F.col("module"), root[0], F.lower(root[0])))
    i = imports.select("module", F.col("confidence").alias("ic"), F.explode(keys).alias("key"))
    return i.join(c, "key").groupBy("package_name", "module").agg(F.max(F.least("cc", "ic")).alias("confidence"))


def declaration_lines(files: DataFrame, name: str) -> DataFrame:
    """Lines that define an identity, by the shapes of common languages."""
    shape = rf"\b(fn|func|def|class|struct|enum|trait|interface|type|function|const|let|var|macro_rules!)\s+{re.escape(name)}\b"
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    return lines.where(F.col("text").rlike(shape)).select("path", (F.col("n") + 1).alias("line"), F.trim("text").alias("text"))
