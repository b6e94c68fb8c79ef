"""The engine's API: what a caller asks, as methods that return DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import text as T
from .operators import code as C
from .operators import readmodel as RM
from .operators import retrieval as R
from .operators import software as Sw
from .operators import state as St
from .sources.scratch import cut
from .sources.store import GraphStore, mutation_batch

SOURCES = ["bm25", "graph_evidence", "semantic", "vector", "graph_path", "temporal", "community_summary"]


@dataclass
class KnowledgeEngine:
    """Ingest and hybrid retrieval over a graph store."""

    store: GraphStore
    disabled: set[str] = field(default_factory=set)

    def ingest(self, requests: DataFrame, **facts: DataFrame) -> int:
        """Evidence rows, and facts that refer to it; returns the new graph version."""
        return self.store.commit(**mutation_batch(requests), **facts)

    def inspect(self) -> DataFrame:
        return self.store.inspect()

    def evidence(self, version: int, scope: str | None = None) -> DataFrame:
        return self._labelled(self.store.table("evidence", version).where(R.retrievable(version, scope)), version)

    def _labelled(self, ev: DataFrame, version: int) -> DataFrame:
        names = self.store.table("evidence_entities", version).join(self.store.table("entities", version), "entity_id")
        labels = names.groupBy("evidence_id").agg(F.array_sort(F.collect_list("label")).alias("labels"))
        return ev.join(labels, "evidence_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))

    def facts(self, version: int, accepted: bool = True) -> DataFrame:
        """(fact_id, kind, text, occurred_at) of visible facts: subject, predicate and object of relations, claims and events."""
        return self.read_model(version).facts(version, accepted).select("fact_id", "kind", "text", "occurred_at")

    def _fact_texts(self, version: int) -> DataFrame:
        ent = self.store.table("entities", version)
        name = lambda k, alias: ent.select(F.col("entity_id").alias(k), F.col("label").alias(alias))
        seen, none = ["created", "valid_from", "valid_until", "status"], F.lit(None).cast("string").alias("occurred_at")
        shape = lambda df, kind, parts, at: df.select("fact_id", F.lit(kind).alias("kind"), F.concat_ws(" ", *parts).alias("text"), at, *seen)
        rel = self.store.table("relations", version).join(name("src_id", "a"), "src_id").join(name("dst_id", "b"), "dst_id")
        cla = self.store.table("claims", version).join(name("subject_id", "a"), "subject_id")
        eve = self.store.table("graph_events", version).join(name("entity_id", "a"), "entity_id", "left").groupBy("fact_id", "event_type", "occurred_at", *seen).agg(F.array_join(F.array_sort(F.collect_list("a")), " ").alias("a"))
        return shape(rel, "relation", ["a", "relation_type", "b"], none).union(shape(cla, "claim", ["a", "predicate", "object"], none)).union(shape(eve, "event", ["event_type", "occurred_at", "a"], F.col("occurred_at")))

    def read_model(self, version: int | None = None) -> RM.ReadModel:
        """The stored read model of a version, beside its tables; written when it is first asked for."""
        v = self.store.version() if version is None else version
        path = f"{self.store.path}/read_models/v={v}"
        model = RM.ReadModel.open(self.store.spark, path)
        if model is None:
            ev = self._labelled(self.store.table("evidence", v), v)
            doc = F.concat_ws(" ", "source_scope", "source_path", F.array_join("labels", " "), "content")
            model = RM.build(ev, self._fact_texts(v), self.store.table("fact_evidence", v), path, doc)
        return model

    def retrieve(self, query: str, limit: int = 10, scope: str | None = None, version: int | None = None, graph_only: bool = False, rerank: bool = True) -> DataFrame:
        """(key, score, sources, labels, facts, content, source_path), best first."""
        R.check_plan(query, limit)
        v = self.store.version() if version is None else version

        def fallback(h: RM.Hits) -> DataFrame | None:
            """Labels and substrings, where no word of the question occurs."""
            if not h.m.where(F.exists("tf", lambda x: x > 0)).isEmpty():
                return None
            ev = self.evidence(v, scope)
            return self._fallback(ev, query, min(200, R.candidate_limit(limit, rerank))).join(ev.select("evidence_id", F.coalesce("parent_id", "evidence_id").alias("key")), "evidence_id").select("key", "score")

        without = self.disabled | ({"semantic", "vector"} if graph_only else set())
        hits = RM.retrieve(self.read_model(v), query, limit, v, scope, without, rerank, fallback)[1]
        return hits.orderBy(F.desc(F.round("score", 9)), "key").limit(limit).select("key", "score", "sources", "labels", "facts", "content", "source_path")

    def _fallback(self, ev: DataFrame, query: str, n: int) -> DataFrame:
        """Exact label or content 1.0, else substring 0.5, else labels within an edit or two; the first stage with any hit counts."""
        q = query.strip().lower()
        most = 1 if len(q.encode()) <= 4 else 2
        exact = F.array_contains(F.transform("labels", F.lower), q) | (F.lower("content") == q)
        like = F.lower("content").contains(q) | F.coalesce(F.lower("source_path").contains(q), F.lit(False))
        near = F.array_min(F.filter(F.transform("labels", lambda x: F.levenshtein(F.lower(x), F.lit(q))), lambda x: x <= most)) if len(q.encode()) >= 3 else F.lit(None).cast("int")
        stage = F.when(exact, 0).when(like, 1).when(near.isNotNull(), 2)
        score = F.when(exact, 1.0).when(like, 0.5).otherwise(0.25 + 0.01 * (most - near))
        x = ev.select("evidence_id", stage.alias("stage"), score.alias("score")).where("stage is not null")
        best = x.agg(F.min("stage").alias("best"))
        return x.join(F.broadcast(best), F.col("stage") == F.col("best")).orderBy("evidence_id").limit(n).select("evidence_id", "score")

    def community(self, query: str, version: int | None = None, scope: str | None = None) -> DataFrame | None:
        """(key, score, content, labels): one summary for each scope, if the query asks for an overview."""
        if not R.wants_community(query):
            return None
        v = self.store.version() if version is None else version
        return self.read_model(v).community(query, v, scope)

    def context_pack(self, query: str, limit: int = 10, budget: int = 65_536, **kw) -> dict:
        """Results within a byte budget with their trace: nodes, edges and a stale flag for readers of older versions."""
        hits = cut(R.byte_budget(self.retrieve(query, limit, **kw), budget, [F.desc(F.round("score", 9)), F.asc("key")], F.octet_length("content")), "pack")
        trace_limit = min(max(4 * limit, limit + 8), 64)
        nodes = hits.select(F.explode("labels").alias("node")).groupBy("node").agg(F.count("*").alias("cited")).orderBy(F.desc("cited"), "node").limit(trace_limit)
        edges = hits.select("key", F.explode("facts").alias("fact")).orderBy("key", "fact").limit(trace_limit)
        return {"version": self.store.version(), "intent": T.routed_intent(query), "results": hits, "trace_nodes": nodes, "trace_edges": edges}

    def freshness(self, indexed: dict[str, int], policy: str = "allow_stale") -> dict[str, int]:
        """Lag of index families; ``wait_until_fresh`` raises if one lags."""
        lag = {k: self.store.version() - v for k, v in indexed.items()}
        if policy == "wait_until_fresh" and any(v > 0 for v in lag.values()):
            raise RuntimeError(f"indexes lag: {lag}")
        return lag


@dataclass
class CodeEngine:
    """Queries over the tables of a code graph: files, symbols, refs, imports, calls, chunks, deps, flags, routes."""

    tables: dict[str, DataFrame]
    default_limit: int = 10

    def query(self, kind: str, text: str, limit: int | None = None, **filters) -> DataFrame:
        """One of hybrid, symbol, definition, references, callers, callees, imports, sbom, impact: (id, path, line, score, layer)."""
        f = C.parse_query(text)
        for k, v in filters.items():
            setattr(f, k, v)
        limit = limit or self.default_limit
        if not (f.text.strip() or f.kinds or f.names or f.paths):
            raise ValueError("a query needs text or a filter")
        kinds = {"symbol": self._symbols, "definition": self._definitions, "references": self._references, "callers": self._callers, "callees": self._callees, "imports": self._imports, "sbom": self._sbom}
        if kind == "impact":
            return self.impact(f.text.split(), []).limit(limit)
        if kind == "hybrid":
            # each layer gives enough rows that those which fall together on a line leave enough others
            most = lambda layer: C.layer_limit(layer, limit)
            parts = [self._symbols(f, most("symbol"), kind), self._references(f, most("reference")), self._imports(f, most("import"), kind), self._chunks(f, most("chunk"), kind)]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            best = out.groupBy("path", "line").agg(F.max("score").alias("score"), F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("id"), F.array_join(F.array_sort(F.collect_set("layer")), " ").alias("layer"))
            return C.hits(best.select("id", "path", "line", "score", "layer"), "id", limit)
        return kinds[kind](f, limit)

    def _out(self, df: DataFrame, id_col: str, layer: str) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), "path", "line", "score", F.lit(layer).alias("layer"))

    def _symbols(self, f, limit, kind="symbol"):
        return self._out(C.search_symbols(self.tables["symbols"], f, limit, kind), "symbol_id", "symbol")

    def _definitions(self, f, limit):
        exact = self.tables["symbols"].where(F.lower("name") == f.text.strip().lower())
        return self._symbols(f, limit) if exact.isEmpty() else self._out(C.search_symbols(exact, f, limit), "symbol_id", "symbol")

    def _references(self, f, limit):
        return self._out(C.search_references(self.tables["refs"], f.text, limit), "ref_id", "reference")

    def _calls(self, column, f, limit):
        return self._out(C.search_calls(self.tables["calls"], column, f.text, limit), "call_id", "call")

    def _callers(self, f, limit):
        return self._calls("callee", f, limit)

    def _callees(self, f, limit):
        return self._calls("caller", f, limit)

    def _imports(self, f, limit, kind="imports"):
        return self._out(C.search_imports(self.tables["imports"], f.text, limit, kind), "import_id", "import")

    def _sbom(self, f, limit):
        s = T.score_query(f.text, [F.col(c) for c in ("package_name", "ecosystem", "path", "requirement")])
        exact = F.lower("package_name") == f.text.strip().lower()
        x = self.tables["deps"].withColumn("b", s).where("b > 0").withColumn("score", F.col("b") + F.when(exact, 8.0).otherwise(0.0) + F.when(F.col("is_lockfile"), 0.25).otherwise(0.0))
        return self._out(C.hits(x.select("dep_id", "path", "line", "score"), "dep_id", limit), "dep_id", "sbom")

    def _chunks(self, f, limit, kind="symbol"):
        return self._out(C.search_chunks(self.tables["chunks"], f, limit, kind), "chunk_id", "chunk")

    def impact(self, changed: list[str], deleted: list[str]) -> DataFrame:
        spark = self.tables["files"].sparkSession
        c = spark.createDataFrame([(p,) for p in changed], "path string")
        d = spark.createDataFrame([(n,) for n in deleted], "name string")
        t = self.tables
        x = C.impact(c, d, t["chunks"], t["calls"], t["symbols"], t["imports"], t["files"])
        return x.orderBy(F.desc("score"), "path", "line")

    def context(self, text: str, limit: int = 8, budget: int = 65_536) -> DataFrame:
        """Three seeds by score, each with up to four references, callers, callees and imports; bytes bounded."""
        seeds = self.query("hybrid", text, limit).unionByName(self.query("definition", text, limit)).unionByName(self.query("symbol", text, limit))
        ids = seeds.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(3)
        s = self.tables["symbols"].join(F.broadcast(ids), F.col("symbol_id") == F.col("id")).select("symbol_id", "name", "score")
        names = [(r.symbol_id, r.name) for r in s.orderBy(F.desc("score"), "symbol_id").collect()]  # three at most
        out = seeds.select(F.lit("").alias("seed"), F.lit("entry").alias("expansion"), "id", "path", "line", "score")
        for sid, name in names:
            for kind in ("references", "callers", "callees", "imports"):
                out = out.unionByName(self.query(kind, name, min(limit, 4)).select(F.lit(sid).alias("seed"), F.lit(kind).alias("expansion"), "id", "path", "line", "score"))
        sized = out.withColumn("bytes", F.octet_length(F.concat_ws(" ", "id", "path", "expansion")))
        return C.running_bytes(sized, F.col("bytes"), [F.when(F.col("expansion") == "entry", 0).otherwise(1).asc(), F.desc("score"), F.asc("id"), F.asc("seed"), F.asc("expansion")], budget)

    def set_query(self, text: str, members: DataFrame, limit: int = 10) -> DataFrame:
        """Hits of every member scope (scope, alias, priority, stale) ranked together, at most three of each above its best - 10 first."""
        base = self.tables["imports"].select("scope", F.col("import_id").alias("id"), "path", "line", T.score_query(text, [F.col("module"), F.col("path")]).alias("b"))
        sym = self.tables["symbols"].select("scope", F.col("symbol_id").alias("id"), "path", F.col("line_start").alias("line"), T.score_query(text, [F.col("name"), F.col("path")]).alias("b"))
        x = base.unionByName(sym).where("b > 0").join(members, "scope")
        hit = self.tables["imports"].join(x.select(F.col("id").alias("import_id")), "import_id", "left_semi")  # only hits need their edges
        edges = C.cross_edges(hit, self.tables["files"]).select(F.col("import_id").alias("id"), "confidence")
        x = x.join(edges, "id", "left").withColumn("score", F.col("b") + F.col("priority") * 0.01 + F.coalesce("confidence", F.lit(0)) / 10000 - F.when(F.col("stale"), 0.5).otherwise(0.0))
        w = Window.partitionBy("alias").orderBy(F.desc(F.round("score", 9)), "path", "line", "id")
        x = x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= C.per_member_limit(limit, members.count()))
        return C.diversify(x, "alias", ["alias", "path", "line"], limit).select("alias", "id", "path", "line", "score")

    def feature_flags(self, text: str = "", limit: int = 20) -> DataFrame:
        return C.feature_flags(self.tables["flags"], text).orderBy(F.desc("score"), "name", "scope").limit(limit)

    def software(self, kind: str, files: DataFrame | None = None, limit: int = 100) -> DataFrame:
        """One of components, sdk, roles, topics, targets, resources, design."""
        if kind == "components":
            out = self.tables["deps"].groupBy("scope", "ecosystem", "package_name").agg(F.when(F.bool_or("is_lockfile"), "locked").otherwise("declared").alias("state"))
        elif kind == "sdk":
            out = self.tables["imports"].where((F.col("resolution") != "resolved") & ~P.is_relative_module(F.col("module"))).groupBy("scope", "module").agg(F.count("*").alias("usages"))
        elif kind == "roles":
            out = self.tables["files"].select("path", P.file_role(F.col("path")).alias("role"))
        else:
            out = {"topics": Sw.topics, "targets": Sw.build_targets, "resources": Sw.deployment_resources, "design": Sw.design_elements}[kind](files)
        return out.orderBy(out.columns).limit(limit)

    def staleness(self, indexed: DataFrame, head: DataFrame) -> DataFrame:
        """(scope, state): fresh, stale (an older commit is indexed) or pending_index (none is)."""
        x = head.join(indexed.withColumnRenamed("commit", "indexed"), "scope", "left")
        return x.select("scope", F.when(F.col("indexed").isNull(), "pending_index").when(F.col("indexed") != F.col("commit"), "stale").otherwise("fresh").alias("state"))


def reconcile(cursors: DataFrame, families: list[str], scopes: DataFrame, current: int) -> DataFrame:
    """After a restart: (family, scope) whose cursor is missing or behind, to be queued again."""
    want = scopes.select("scope", F.explode(F.array(*map(F.lit, families))).alias("family"))
    x = want.join(cursors, ["family", "scope"], "left")
    return x.where(F.coalesce(F.col("indexed_version"), F.lit(0)) < current).select("family", "scope", (F.lit(current) - F.coalesce("indexed_version", F.lit(0))).alias("lag"))


__all__ = ["CodeEngine", "KnowledgeEngine", "St", "reconcile"]
