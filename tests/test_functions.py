import pytest
from pyspark.sql import functions as F

from cairn.functions import paths as P
from cairn.functions import text as T


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_term_golden(spark):
    text = "GraphContextPack retry_policy RESTClient W3Connector"
    want = {"graphcontextpack", "graph", "context", "pack", "gcp", "retry_policy", "retry", "policy", "rp", "rest", "client", "rc", "w3connector", "connector", "w3c"}
    got = set(one(spark, T.terms(F.lit(text))))
    assert want <= got and not {"w", "3"} & got
    assert sorted(got) == T.driver_terms(text)


@pytest.mark.parametrize("text", ["", "plain words", "HTTPServer2x a1b2", "ÄÖx für Straße", "x_y__z _", "ABC aBC AbC", "日本 語a"])
def test_column_and_driver_terms_agree(spark, text):
    assert one(spark, T.terms(F.lit(text), 1)) == T.driver_terms(text, 1)


def test_candidate_terms_prefer_structure():
    assert T.candidate_terms(["ab", "retry_policy", "internationalization", "abcde"]) == ["retry_policy", "internationalization", "abcde", "ab"]
    assert len(T.candidate_terms([f"t{i}" for i in range(40)])) == 16


def test_hash_and_vectors_agree(spark):
    def fnv(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = ((h ^ x) * 0x100000001B3) % 2**64
        return h

    import pandas as pd

    for t in ["a", "straße", "retry_policy", "日本"]:
        assert one(spark, T.low_hash(F.lit(t))) == T.driver_hash(t) == fnv(t.encode()) % 16
    terms = ["a", "bb", "straße", "x_y"]
    v = one(spark, T.hashed_vector(T.lit_array(terms)))
    assert v == pytest.approx(T.driver_vector(terms)) and v == pytest.approx(list(T.hashed_vectors(pd.Series([terms]))[0]))
    assert T.hashed_vectors(pd.Series([[], None])).sum() == 0


@pytest.mark.parametrize("query,content,want", [("sqlite async", "Async SQLite worker", 2), ("sqlite sqlite", "sqlite", 2), ("retries", "no retry here", 0), ("retry", "RetryPolicy", 1), ("policyholder", "a policy", 1), ("xy", "no", 0)])
def test_overlap(spark, query, content, want):
    assert one(spark, T.overlap_score(query, F.lit(content), F.array().cast("array<string>"), F.lit(None).cast("string"))) == want


def test_scores(spark):
    assert one(spark, T.score_query("fn_7", [F.lit("fn_7")])) == 4
    assert one(spark, T.score_query("retry", [F.lit("retry_policy")])) == 2
    assert one(spark, T.score_query("etr", [F.lit("retry_policy")])) == 0.5
    assert one(spark, T.exact_path("a/b.py", F.lit("A/b.py"))) == 4 and one(spark, T.exact_path("b.py", F.lit("a/b.py"))) == 2
    assert one(spark, T.semantic_overlap(["a", "b"], F.array(F.lit("a"), F.lit("c")))) == pytest.approx(1 / 2 + 1 / 3)


@pytest.mark.parametrize("text,want", [("2024", (2024, None, None)), ("2024-05", (2024, 5, None)), ("2024/5/7", (2024, 5, 7)), ("2024-13", None), ("x", None), ("2024-05-07T10:00", (2024, 5, 7))])
def test_partial_dates(spark, text, want):
    got = one(spark, T.partial_date(F.lit(text)))
    assert (tuple(got) if got else None) == want


def test_paths(spark):
    b = lambda c: one(spark, c)
    assert b(P.matches_filter(F.lit("src/a.py"), "./src/")) and not b(P.matches_filter(F.lit("srcs/a.py"), "src")) and b(P.matches_filter(F.lit("x"), "."))
    assert b(P.language(F.lit("a/b.tsx"))) == "tsx" and b(P.language(F.lit("README"))) is None
    assert b(P.is_generated(F.lit("a/x.pb.go"), F.lit(""))) and b(P.is_generated(F.lit("a.py"), F.lit("# @generated"))) and not b(P.is_generated(F.lit("a.py"), F.lit("x")))
    assert b(P.url_matches(F.lit("/a/:id/c"), F.lit("/a/7/c"))) and not b(P.url_matches(F.lit("/a/b"), F.lit("/a/b"))) and not b(P.url_matches(F.lit("/a/{x}"), F.lit("/a/b/c")))
    assert b(P.module_contains(F.lit("a::bc::d"), F.lit("bc.d"))) and not b(P.module_contains(F.lit("a::bcd"), F.lit("bc")))
    assert "crate::x::y" in b(P.module_keys(F.lit("src/x/y.rs"))) and b(P.is_relative_module(F.lit("./x"))) and not b(P.is_relative_module(F.lit("x")))
    assert b(P.http_method(F.lit("get"))) == "GET" and b(P.http_method(F.lit("fetch"))) is None


def test_innermost_spans_match_brute_force(spark):
    """Spans that nest, overlap, repeat, are empty or very long, in files of up to a million lines."""
    import random

    from cairn.operators import code as C

    r = random.Random(3)
    spans = [(f"f{i % 3}", a, a + n, f"s{i}") for i in range(300) for a, n in [(r.choice([r.randint(1, 200), r.randint(1, 9000), r.randint(1, 900_000)]), r.choice([0, -1, 3, 64, 700, 50_000]))]]
    lines = [(i, f"f{r.randint(0, 3)}", r.choice([r.randint(1, 260), r.randint(1, 9500), r.randint(1, 950_000)])) for i in range(500)]
    s = spark.createDataFrame([(f, a, b, n, n) for f, a, b, n in spans], "file_id string, line_start long, line_end long, name string, symbol_id string")
    x = spark.createDataFrame(lines, "ref_id long, file_id string, line long")
    want = {}
    for i, f, at in lines:
        over = [(a, -b, n) for g, a, b, n in spans if g == f and a <= at <= b]
        if over:
            want[i] = max(over)[2]
    assert want and {r.ref_id: r.symbol_id for r in C.enclosing(x, s, "ref_id").collect()} == want
    c = s.withColumnRenamed("symbol_id", "chunk_id")
    want = {i: min((b - a, n) for g, a, b, n in spans if g == f and a <= at <= b)[1] for i, f, at in lines if any(g == f and a <= at <= b for g, a, b, n in spans)}
    assert {r.ref_id: r.chunk_id for r in C.innermost_chunks(x, c, "ref_id").collect()} == want
    assert C.enclosing(x, s.limit(0), "ref_id").count() == 0


def test_path_roles_and_intents(spark):
    from cairn.operators import scoring as Sc

    got = lambda words, p: one(spark, Sc.has_role(F.lit(p), words))
    assert [got(Sc.TEST, p) for p in ("src/tests/a.py", "a_test.go", "x/test1.c", "src/contest.py", "src/testify.go", "__tests__/b.ts", "bench/run.rs")] == [True, True, True, False, False, True, True]
    assert got(Sc.EXAMPLE, "docs/examples/x.py") and not got(Sc.EXAMPLE, "resample.py") and got(Sc.ADAPTER, "lib/ffi.rs")
    assert Sc.asks_for("where is runTests used", Sc.TEST) and Sc.asks_for("api_bridge", Sc.ADAPTER) and not Sc.asks_for("contest latest", Sc.TEST)
    assert one(spark, Sc.call_paths(F.lit("src/c.rs"), "go", True)) == 0 and one(spark, Sc.call_paths(F.lit("src/c.rs"), "go", False)) == 0.2
    assert one(spark, Sc.call_paths(F.lit("tests/a.rs"), "go", True)) == -0.75 and one(spark, Sc.reference_paths(F.lit("tests/a.rs"), "go tests")) == 0
    assert one(spark, Sc.symbol_paths(F.lit("inc/a.hpp"), F.lit("function_declaration"), "go", "hybrid")) == 0.55
    assert one(spark, Sc.import_shape(F.lit("pkg/__init__.py"), F.lit("x"), F.lit(1), "go", "hybrid")) == 0.2
    text = "\n".join(["alpha", "", "betaGamma", "delta_eps", "zeta", "eta theta"])
    q = "alpha beta gamma delta eps zeta"
    assert one(spark, Sc.proximity(F.lit(6.0), F.lit(text), F.lit("a.py"), q)) == pytest.approx(1.9)
    assert one(spark, Sc.proximity(F.lit(5.0), F.lit(text), F.lit("a.py"), q)) == 0 and one(spark, Sc.proximity(F.lit(6.0), F.lit("\n" * 9), F.lit("a.py"), q)) == 0
    far = "\n".join(x for w in q.split() for x in [w, *["-- -"] * 3, "other"] * 1)
    assert one(spark, Sc.proximity(F.lit(6.0), F.lit(far), F.lit("a.py"), q)) == 0


def test_scratch_tables_are_removed_on_any_file_system(spark, tmp_path):
    """A path that isn't known to be mounted goes through the cluster's file system."""
    import os

    from cairn.sources import scratch as S

    df = S.cut(spark.range(10).toDF("a"), "some")
    folder = S.local_path(df._scratch)
    assert df.count() == 10 and os.listdir(folder) and df._scratch in S._made
    S.drop(df)
    assert not os.path.exists(folder) and df._scratch not in S._made
    other = tmp_path / "x"
    spark.range(3).write.parquet(f"file://{other}")
    S.remove(f"File:{other}")
    assert not other.exists()
    with pytest.raises(ValueError):
        S.local_path("s3a://bucket/x")
