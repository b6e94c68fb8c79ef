"""Joins of code queries at size: what grows with the tables is met by keys, and meets no row more than it must."""

import pytest

import __spark_entry__ as entry


def broadcasts(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


@pytest.mark.parametrize("name", ["enclosing_caller", "import_resolution", "imported_reference_resolution", "cross_repo_edges", "overlay_counts"])
def test_no_view_is_sent_to_the_driver(spark, sf, name):
    assert broadcasts(entry.queries()[name](spark, sf)) == 0


def test_versions_are_handed_down_without_listing_ancestors(spark, monkeypatch):
    """A chain of 300 projects: no table between has a row for each project and ancestor."""
    from pyspark.sql import functions as F

    from cairn.operators import software as Sw

    most, cut = [0], Sw.cut

    def counted(df, name):
        out = cut(df, name)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(Sw, "cut", counted)
    n = 300
    k = spark.range(n).select(F.col("id").cast("string").alias("project"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    props = spark.createDataFrame([("0", "v", "7"), ("200", "v", "8")], "project string, name string, value string")
    man = spark.createDataFrame([("0", "lib", "${v}"), ("0", "other", "1")], "project string, artifact string, version string")
    dep = spark.createDataFrame([("2", "lib", None), ("250", "lib", "3"), ("nowhere", "lib", "4")], "project string, artifact string, version string")
    got = {r.project: r.version for r in Sw.effective_models(k, props, man, dep).collect()}
    assert got == {str(i): "7" if i < 200 else "8" if i < 250 else "3" for i in range(2, n)}
    assert most[0] <= 4 * n


def test_the_read_model_shuffles_no_postings(spark, tmp_path):
    """Texts are indexed by the tasks that read them, whatever the question's number of terms; copies of an id stay apart."""
    from pyspark.sql import functions as F

    from cairn.operators import readmodel as RM

    ev = spark.range(300).select(F.concat(F.lit("e"), (F.col("id") % 299).cast("string")).alias("evidence_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("s").alias("source_scope"), F.lit("a/b").alias("source_path"), F.array(F.lit("Label")).alias("labels"), F.concat(F.lit("fooBar word word w"), F.col("id").cast("string")).alias("content"), F.lit(1).cast("long").alias("created"), F.lit("accepted").alias("status"))
    facts = spark.createDataFrame([("f", "relation", "fooBar knows W7", None, 1, 1, None, "accepted")], "fact_id string, kind string, text string, occurred_at string, created long, valid_from long, valid_until long, status string")
    links = spark.createDataFrame([("f", 0, "e5")], "fact_id string, pos int, evidence_id string")
    tracker, seen = spark.sparkContext.statusTracker(), []
    spark.sparkContext.setJobGroup("readmodel", "")
    m = RM.build(ev, facts, links, f"file://{tmp_path}/m")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    index = spark.read.parquet(f"file://{tmp_path}/m/index")
    assert tracker is not None and "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert index.where(F.col("kind") != RM.DOC).count() < 300 * 12  # a row for each term of a slice, not for each of its documents
    assert index.where("kind = 0 and term = 'word'").select(F.inline(F.arrays_zip("ids", "tfs"))).where("tfs = 2").count() == 300
    for terms, sent in ((5000, 200_000), (1, 200_000), (1, 1)):
        RM.MOST_TERMS, RM.MOST_SENT, old = terms, sent, (RM.MOST_TERMS, RM.MOST_SENT)
        try:
            h = m.hits("foobar w7", 1)
            seen.append((h.m.count(), h.f.collect(), m.bm25(h).agg(F.round(F.sum("score"), 6)).first()[0], m.graph_path(h, 1).select("key", "score").collect()))
        finally:
            RM.MOST_TERMS, RM.MOST_SENT = old
    assert seen[0][0] == 300 and seen[0][3][0].key == "e5" and seen[0] == seen[1] == seen[2]


def test_nearest_in_blocks_equals_every_pair(spark):
    """Ties, copies of an id, zero and missing vectors, and several blocks on both sides; no row for each pair."""
    import numpy as np
    from pyspark.sql import functions as F

    from cairn.operators import retrieval as R

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)] + [(7, [1.0, 1.0, 1.0, 1.0]), (200, None), (201, [0.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    q = v.where("vec_id % 10 = 7")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    few = R.nearest(v, q.where("vec_id <> 7"), 5, 16)
    assert "BroadcastNestedLoop" not in few._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in few.collect():
        got.setdefault(r.q, []).append((r["rank"], r.vec_id))
    for i, a in rows:
        if i % 10 == 7 and i != 7 and any(a):
            every = sorted((-round(cos(a, b), 9), j) for j, b in rows if j != i and b is not None and any(b))[:5]
            assert [j for _, j in sorted(got[i])] == [j for _, j in every]
    assert 7 not in {j for x in [R.nearest(v, q.where("vec_id = 7").limit(1), 122, 16)] for j in [r.vec_id for r in x.collect()]}
    assert F is not None


def test_edges_of_a_file_are_reduced_before_its_hits(spark):
    """A file of 300 imports and edges: its hits meet a sum and its first edges, not each other."""
    from pyspark.sql import functions as F

    from cairn.operators import code as C

    n = 300
    i = spark.range(n).select(F.concat(F.lit("i"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("import_id"), F.lit("x").alias("file_id"), F.lit("resolved").alias("state"), F.lit("x").alias("to_file"), F.when(F.col("id") < 5, 5000).otherwise(10000).alias("confidence"))
    edges = i.select("import_id", F.col("file_id").alias("from_file"), "to_file", "state", "confidence")
    e = C.overlay_evidence(i.select(F.col("import_id").alias("id"), "file_id"), edges)
    got = {}
    for r in e.collect():
        got.setdefault(r.hit, []).append((r.via, r.import_id))
    assert len(got) == n and sorted(got["i000"]) == [(0, "i000"), (1, "i005"), (1, "i006")] and sorted(got["i005"]) == [(0, "i005"), (1, "i006"), (1, "i007")]
    b = C.bridge_bonus(i.select(F.col("import_id").alias("hit"), "file_id"), edges)
    assert {r.bonus for r in b.collect()} == {0.7} and b.count() == n
    small = C.bridge_bonus(i.select(F.col("import_id").alias("hit"), "file_id"), edges.where("import_id = 'i000'"))
    assert {round(r.bonus, 9) for r in small.collect()} == {0.175}

    def most_rows(df) -> int:
        """The most rows that a join of the executed plan put out."""
        def walk(p):
            kids = p.children()
            own = [p.metrics().apply("numOutputRows").value()] if "Join" in p.nodeName() and p.metrics().contains("numOutputRows") else []
            inner = [p.executedPlan()] if p.nodeName().startswith("AdaptiveSparkPlan") else [p.plan()] if "QueryStage" in p.nodeName() else []
            return own + [x for k in [*[kids.apply(j) for j in range(kids.size())], *inner] for x in walk(k)]

        df.collect()
        return max(walk(df._jdf.queryExecution().executedPlan()))

    assert most_rows(e) <= 4 * n and most_rows(b) <= n


@pytest.mark.parametrize("name", ["reference_resolution", "call_target_resolution"])
def test_references_are_dealt_out_for_paths_alone(spark, sf, name):
    """Few names are sent to the references; files and definitions by path are met by keys."""
    df = entry.queries()[name](spark, sf)
    assert broadcasts(df) == 1 and df._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 2
