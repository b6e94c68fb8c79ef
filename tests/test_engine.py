"""The labelled retrieval cases, the store, and code queries over extracted sources."""

import pytest
from pyspark.sql import functions as F

from cairn.engine import CodeEngine, KnowledgeEngine, reconcile
from cairn.operators import code as C
from cairn.operators import extract as X
from cairn.operators import software as Sw
from cairn.operators import state as St
from cairn.sources import providers, store
from cairn.streaming import watch

ROWS = [
    ("fact", "One exact fact: async SQLite lookups ground answers by BM25", ["SQLite"]),
    ("path", "Walking a GraphRAG path ties schemas with recall from vector stores", ["GraphRAG", "Vector"]),
    ("time", "A vendor release falls in the 2026 timeline of retrieval work", ["Vendor"]),
    ("rust-code", "Ownership in the Rust language, for async services", ["Rust"]),
    ("rust-metal", "Maintenance notes on rust found while inspecting material", ["Rust"]),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    g = store.GraphStore(spark, f"file://{tmp_path_factory.mktemp('graph')}")
    e = KnowledgeEngine(g)
    assert g.version() == 0 and g.read_after(0).count() == 0
    ev = spark.createDataFrame([("docs", *r) for r in ROWS], "source_scope string, evidence_id string, content string, entity_labels array<string>")
    assert e.ingest(ev) == 1
    ent = {r.label: r.entity_id for r in g.table("entities").collect()}
    rel = spark.createDataFrame([("rel-1", ent["GraphRAG"], "uses", ent["Vector"])], "fact_id string, src_id string, relation_type string, dst_id string")
    eve = spark.createDataFrame([("event-1", "release", "2026-05-13", ent["Vendor"])], "fact_id string, event_type string, occurred_at string, entity_id string")
    links = spark.createDataFrame([("rel-1", 0, "path"), ("event-1", 0, "time")], "fact_id string, pos int, evidence_id string")
    rejected = spark.createDataFrame([("no", "docs", "Context that was only rejected may never ground an answer", "rejected")], "evidence_id string, source_scope string, content string, status string")
    assert g.commit(relations=rel, graph_events=eve, fact_evidence=links, evidence=rejected) == 2
    return e


@pytest.mark.parametrize("query,must,source", [("exact fact async sqlite", {"fact"}, "bm25"), ("GraphRAG uses vector path", {"path"}, "graph_path"), ("timeline 2026 vendor release", {"time"}, "temporal"), ("rust", {"rust-code", "rust-metal"}, None)])
def test_labelled_cases(engine, query, must, source):
    got = {r.key: r for r in engine.retrieve(query).collect()}
    assert must <= set(got) and "no" not in got
    if source:
        assert source in got[next(iter(must))].sources


def test_rejected_context_never_grounds(engine):
    assert "no" not in {r.key for r in engine.retrieve("only rejected context").collect()}


def test_stale_indexes_are_told(engine):
    assert engine.freshness({"bm25": 1}) == {"bm25": 1}
    with pytest.raises(RuntimeError):
        engine.freshness({"bm25": 1}, "wait_until_fresh")


def test_versions_fallback_pack_and_limits(engine):
    assert {r.key for r in engine.retrieve("GraphRAG uses", version=1).collect()}
    assert engine.retrieve("Rvst", limit=5).count() == 2  # one edit from Rust
    pack = engine.context_pack("rust async", budget=60)
    assert pack["results"].agg(F.sum("bytes")).first()[0] <= 60 and pack["intent"] == "direct"
    assert engine.community("rust") is None and engine.community("overview").count() == 1
    for q, n in (("", 5), ("x", 0), ("x", 51)):
        with pytest.raises(ValueError):
            engine.retrieve(q, n)


def test_store_rejects_bad_batches(engine, spark):
    g = engine.store
    before = g.version()
    bad = [
        {"fact_evidence": spark.createDataFrame([("f", 0, "nowhere")], "fact_id string, pos int, evidence_id string")},
        {"evidence": spark.createDataFrame([("c", "docs", "x", "missing")], "evidence_id string, source_scope string, content string, parent_id string")},
        {"evidence": spark.createDataFrame([("c", "docs", "x", "maybe")], "evidence_id string, source_scope string, content string, status string")},
    ]
    for b in bad:
        with pytest.raises(store.StoreError):
            g.commit(**b)
    assert g.version() == before and g.orphans().count() == 0
    assert {r.item: r.n for r in g.inspect().collect()}["evidence"] == 6


SOURCES = {
    "src/app/main.py": "import os\nfrom app.util import helper\n\nclass Shop:\n    def buy(self):\n        return helper(os.getenv('SHOP_FLAG'))\n\n@app.route('/items/<id>', methods=['POST'])\ndef items():\n    return Shop().buy()\n",
    "src/app/util.py": "def helper(x):\n    '''Helps.'''\n    return x\n",
    "src/lib.rs": "use crate::net::client;\npub fn start() {\n    client::go();\n}\nstruct Conf;\n#[cfg(feature = \"fast\")]\nfn quick() {}\n",
    "src/broken.py": "def (:\n",
    "web/server.ts": "import x from 'express';\nexport function boot() { app.get('/ping', ok); }\nif (client.isEnabled('new-ui')) {}\n",
    "package.json": '{"dependencies": {"express": "^4"}, "workspaces": ["packages/*"]}',
    "package-lock.json": '{"packages": {"": {}, "node_modules/express": {"version": "4.1.0"}}}',
    "Cargo.toml": '[workspace]\nmembers = ["a", "b"]\n[dependencies]\nserde = "1"\n',
    "requirements.txt": "flask==2.0\n# no\nnumpy\n",
    "go.mod": "module m\nrequire github.com/x/y v1.2.3\n",
    "conf/app.yaml": "feature.checkout: true\nname: ${APP_NAME}\n",
    "docs/guide.md": "# Guide\n\n## Set up ##\ntext\n",
    "Makefile": "build:\n\tmake x\n",
    "Dockerfile": "FROM alpine:3\n",
    "dist/a.js": "x\n",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in SOURCES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / ".git").mkdir()
    (root / ".git/config").write_text("x")
    return store.read_files(spark, f"file://{root}", "s").cache()


@pytest.fixture(scope="module")
def facts(files):
    return X.extract(files).cache()


def names(facts, fact, path=None):
    f = facts.where(F.col("fact") == fact)
    return {(r.path, r.name, r.kind) for r in (f.where(F.col("path") == path) if path else f).collect()}


def test_files_and_facts(files, facts):
    assert {r.path for r in files.collect()} == set(SOURCES)
    assert {("src/app/main.py", "Shop", "class"), ("src/app/main.py", "buy", "method"), ("src/app/main.py", "items", "function"), ("src/lib.rs", "start", "function"), ("src/lib.rs", "Conf", "struct"), ("web/server.ts", "boot", "function"), ("docs/guide.md", "Guide", "heading")} <= names(facts, "symbol")
    assert {("src/app/main.py", "app.util", "symbol"), ("src/lib.rs", "crate::net::client", "module"), ("web/server.ts", "express", "module")} <= names(facts, "import")
    assert ("src/app/main.py", "helper", "call") in names(facts, "reference") and ("src/broken.py", "parse", "degraded") in names(facts, "diagnostic")
    assert {(n, k) for _, n, k in names(facts, "dependency")} == {("express", "npm"), ("serde", "cargo"), ("flask", "python"), ("numpy", "python"), ("github.com/x/y", "go")}
    assert {n for _, n, _ in names(facts, "flag")} >= {"SHOP_FLAG", "fast", "new-ui", "feature.checkout"}
    assert {(n, k) for _, n, k in names(facts, "route")} == {("/items/<id>", "POST"), ("/ping", "GET")}
    assert {n for _, n, _ in names(facts, "workspace")} == {"packages/*", "a", "b"}
    assert ("conf/app.yaml", "APP_NAME", "variable") in names(facts, "config")
    assert {r.name for r in facts.where("fact = 'chunk' and path = 'src/broken.py'").collect()} == {""}


def test_chunks_keep_long_symbols_uncovered_source_and_manifests(spark):
    long = "def f():\n" + "".join(f"    x{i} = {i}\n" for i in range(300)) + "    return last_of_f\n"
    texts = {
        "long.py": "TOP = 1\n" + long,
        "top.py": "# about\nLIMIT = 3\n\ndef g():\n    return LIMIT\n",
        "covered.py": "def g():\n    return 1\n\n\ndef h():\n    return 2\n",
        "a/package.json": '{"padding": "' + "x" * 9000 + '", "main": "tail.ts"}',
        "conf.json": '{"padding": "' + "x" * 9000 + '", "main": "tail.ts"}',
        "b/go.mod": "// " + "x" * 9000 + "\nmodule tail\n",
        "guide.md": "intro\n# One\n" + "text\n" * 300,
        "wide.py": "def w():\n    return '" + "é" * 5000 + "'\n",
    }
    files = spark.createDataFrame([("s", p, p, t) for p, t in texts.items()], "scope string, file_id string, path string, content string")
    got = {(r.path, r.name): r for r in X.extract(files).where("fact = 'chunk'").collect()}
    assert set(got) == {("long.py", "f"), ("top.py", "g"), ("top.py", ""), ("covered.py", "g"), ("covered.py", "h"), ("a/package.json", ""), ("conf.json", ""), ("b/go.mod", ""), ("guide.md", "One"), ("guide.md", ""), ("wide.py", "w")}
    assert got["long.py", "f"].content == long.strip() and got["long.py", "f"].line_end == 303
    assert got["top.py", ""].content == texts["top.py"].strip() and (got["top.py", ""].line_start, got["top.py", ""].line_end) == (1, 6)
    assert got["a/package.json", ""].content == texts["a/package.json"] and got["b/go.mod", ""].content == texts["b/go.mod"].strip()
    assert len(got["conf.json", ""].content) == 8000 and got["guide.md", ""].content.startswith("intro")
    assert 7990 <= len(got["wide.py", "w"].content.encode()) <= 8000


def test_software_views(files):
    assert [(r.topic, r.level) for r in Sw.topics(files).orderBy("line").collect()] == [("Guide", 1), ("Set up", 2)]
    assert {(r.kind, r.name) for r in Sw.build_targets(files).collect()} >= {("make", "build"), ("go", "m")}
    assert {(r.kind, r.name) for r in Sw.deployment_resources(files).collect()} >= {("docker", "alpine:3")}
    assert {(r.path, r.line) for r in Sw.declaration_lines(files, "helper").collect()} == {("src/app/util.py", 1)}
    assert {(r.path, r.line) for r in X.grep(files, "helper").collect()} == {("src/app/main.py", 2), ("src/app/main.py", 6), ("src/app/util.py", 1)}


def test_effective_models(spark):
    p = spark.createDataFrame([("root", None), ("mid", "root"), ("leaf", "mid")], "project string, parent string")
    props = spark.createDataFrame([("root", "v", "1"), ("mid", "v", "2")], "project string, name string, value string")
    man = spark.createDataFrame([("root", "a", "${v}"), ("root", "b", "9")], "project string, artifact string, version string")
    dep = spark.createDataFrame([("leaf", "a", None), ("mid", "b", "3"), ("leaf", "c", None)], "project string, artifact string, version string")
    got = {(r.project, r.artifact): r.version for r in Sw.effective_models(p, props, man, dep).collect()}
    assert got == {("leaf", "a"): "2", ("leaf", "b"): "3", ("mid", "b"): "3", ("leaf", "c"): None}


def test_effective_models_of_long_chains_and_cycles(spark):
    p = spark.createDataFrame([("p0", None), *((f"p{i}", f"p{i - 1}") for i in range(1, 70)), ("a", "b"), ("b", "a"), ("self", "self")], "project string, parent string")
    props = spark.createDataFrame([("p0", "v", "1"), ("a", "v", "7")], "project string, name string, value string")
    man = spark.createDataFrame([("p0", "x", "${v}"), ("b", "x", "${v}")], "project string, artifact string, version string")
    dep = spark.createDataFrame([("p69", "x", None), ("a", "x", None), ("self", "x", "3")], "project string, artifact string, version string")
    got = {(r.project, r.artifact): r.version for r in Sw.effective_models(p, props, man, dep).collect()}
    assert got == {("p69", "x"): "1", ("a", "x"): "7", ("b", "x"): "7", ("self", "x"): "3"}


def test_knowledge_map_and_usages(spark):
    t = spark.createDataFrame([("Billing", ["s2", "s1"])], "topic string, source_order array<string>")
    s = spark.createDataFrame([("s1", "a"), ("s2", "b")], "source_id string, uri string")
    assert [r.uri for r in Sw.route_topic(t, s, " billing ").collect()] == ["b", "a"]
    c = spark.createDataFrame([("serde-json", "cargo", 9000), ("Flask", "python", 8000)], "package_name string, ecosystem string, confidence int")
    i = spark.createDataFrame([("serde_json::Value", 5000), ("flask.app", 9500), ("other", 1)], "module string, confidence int")
    assert {(r.package_name, r.confidence) for r in Sw.usages(c, i).collect()} == {("serde-json", 5000), ("Flask", 8000)}


def test_sources_and_scopes(spark, files, tmp_path):
    base = store.fingerprints(files)
    head = base.where("path <> 'go.mod'").withColumn("blob_hash", F.when(F.col("path") == "Makefile", "new").otherwise(F.col("blob_hash"))).withColumn("path", F.when(F.col("path") == "Dockerfile", "deploy/Dockerfile").otherwise(F.col("path")))
    got = {r.path: (r.change, r.old_path) for r in store.diff(base, head).where("change <> 'deleted' or path = 'go.mod'").collect()}
    assert got["Makefile"][0] == "modified" and got["go.mod"][0] in ("deleted", "renamed") and got["deploy/Dockerfile"] == ("renamed", "Dockerfile")
    idx = store.file_index(spark.createDataFrame([("a", 1, "indexed"), ("b", 1, "indexed")], "path string, byte_len long, status string"), spark.createDataFrame([("a", 2)], "path string, byte_len long"), True)
    assert {r.path: (r.byte_len, r.status) for r in idx.collect()} == {"a": (2, "indexed"), "b": (1, "missing")}
    b = store.batches(files, most_files=4)
    assert b.groupBy("batch").count().agg(F.max("count")).first()[0] <= 4
    path = f"file://{tmp_path}/t"
    store.replace_scopes(spark.createDataFrame([("x", 1), ("y", 1)], "scope string, v int"), path)
    store.replace_scopes(spark.createDataFrame([("x", 2)], "scope string, v int"), path)
    assert {(r.scope, r.v) for r in spark.read.parquet(path).collect()} == {("x", 2), ("y", 1)}
    o = store.overlay(spark.createDataFrame([("p", 1), ("q", 1)], "path string, v int"), spark.createDataFrame([("p",)], "path string"), spark.createDataFrame([("p", 2)], "path string, v int"))
    assert {(r.path, r.v) for r in o.collect()} == {("p", 2), ("q", 1)}


@pytest.fixture(scope="module")
def code(spark, sf):
    from cairn.plans.code_queries import view

    return CodeEngine({k: view(spark, sf, f"code_{k}") for k in ("files", "symbols", "refs", "imports", "calls", "chunks", "deps", "flags")})


@pytest.mark.parametrize("kind", ["hybrid", "symbol", "definition", "references", "callers", "callees", "imports", "sbom"])
def test_code_query_kinds(code, kind):
    text = {"imports": "mod_49", "sbom": "pkg-building-7"}.get(kind, "fn_262")
    got = code.query(kind, text, 5).collect()
    assert 0 < len(got) <= 5 and [round(r.score, 9) for r in got] == sorted((round(r.score, 9) for r in got), reverse=True)


def test_code_contexts(code, spark, sf):
    from cairn.plans.code_queries import view

    assert code.context("fn_262", budget=2000).agg(F.sum("bytes")).first()[0] <= 2000
    path = code.tables["files"].first().path
    assert {r.kind for r in code.impact([path], ["fn_5"]).collect()} >= {"changed"}
    assert code.query("impact", path, 3).count() == 3
    assert code.set_query("fn_262 mod_49", view(spark, sf, "repo_members"), 6).count() <= 6
    assert code.feature_flags("click", 3).count() == 3
    for kind in ("components", "sdk", "roles"):
        assert code.software(kind, limit=5).count() == 5
    h = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "scope string, commit string")
    i = spark.createDataFrame([("a", "1"), ("c", "1")], "scope string, commit string")
    assert {r.scope: r.state for r in code.staleness(i, h).collect()} == {"a": "fresh", "b": "pending_index", "c": "stale"}
    with pytest.raises(ValueError):
        code.query("symbol", " ")


def test_query_qualifiers():
    f = C.parse_query("kind:function,method lang:rust path:storage name:query search_code")
    assert (f.kinds, f.languages, f.paths, f.names, f.text) == (["function", "method"], ["rust"], ["storage"], ["query"], "search_code")
    assert C.parse_query("path::normalize name::Worker").text == "path::normalize name::Worker"
    assert C.layer_limit("symbol", 10) == 400 and C.layer_limit("chunk", 1) == 300 and C.layer_limit("import", 100) == 700


def test_providers(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(150)], "id long, text string")
    got = {r.id: r.vector for r in providers.embed_column(df, "id", "text", providers.echo(8), 8).collect()}
    assert len(got) == 150 and got[3] == pytest.approx(providers.echo(8)(["t3"])[0])
    with pytest.raises(Exception, match="vector of 4"):
        providers.embed_column(df, "id", "text", providers.echo(8), 4).collect()
    tasks = spark.createDataFrame([(1, "ocr", '{"text": "a"}'), (2, "ocr", "{bad"), (3, "ocr", "{}")], "task_id long, kind string, payload string")
    out = {r.task_id: (r.state, r.content) for r in providers.run_workers(tasks, lambda t: {"content": t.get("text")}).collect()}
    assert out == {1: ("proposed", "a"), 2: ("failed", None), 3: ("failed", None)}


def test_queue_rules(spark):
    t = spark.createDataFrame([(1, "running", 3, 5, 1, 0, 10), (2, "running", 1, 4, 1, 0, 10), (3, "queued", 0, 6, 1, 0, 0), (4, "retrying", 1, 1, 1, 999, 0)], "task_id long, state string, attempts int, created_ms long, target_version long, next_retry_ms long, lease_until_ms long")
    assert [r.task_id for r in St.claim(t, 100, 5).collect()] == [2, 3]
    assert {r.task_id: r.state for r in St.recover(t, 100).collect()} == {1: "dead_letter", 2: "retrying", 3: "queued", 4: "retrying"}
    cur = spark.createDataFrame([("bm25", "a", 5), ("bm25", "b", 2)], "family string, scope string, indexed_version long")
    got = reconcile(cur, ["bm25", "vector"], spark.createDataFrame([("a",), ("b",)], "scope string"), 5)
    assert {(r.family, r.scope, r.lag) for r in got.collect()} == {("bm25", "b", 3), ("vector", "a", 5), ("vector", "b", 5)}


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a.py", "h1"), ("2024-01-01 00:00:02", "b.py", "h2"), ("2024-01-01 00:00:03", "b.txt", "h0"), ("2024-01-01 00:01:00", "a.py", "h1"), ("2024-01-01 01:00:00", "node_modules/x/c.js", "h3"), ("2024-01-01 02:00:00", "z.rs", "h4")]
    df = spark.createDataFrame(rows, "ts string, path string, hash string").withColumn("ts", F.col("ts").cast("timestamp"))
    src = f"file://{tmp_path}/in"
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = watch.debounced(stream).writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    q = watch.debounced(stream).writeStream.format("memory").queryName("debounced2").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(sorted(r.paths)) for r in spark.table("debounced2").collect()} == {("a.py", "b.py"), ("a.py",), ("z.rs",)}
    q = watch.new_contents(stream).writeStream.format("memory").queryName("fresh").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fresh").count() == 5
    target = f"file://{tmp_path}/out"
    for _ in range(2):
        watch.refresh_into(stream, target, f"file://{tmp_path}/ck", ["path"]).start().awaitTermination()
    assert spark.read.parquet(target).count() == 5
