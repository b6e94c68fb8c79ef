import re

from conftest_llm import WORD

from cairn.llm import quality as Q


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {g for g in grams if grams.count(g) > 1} if len(grams) < 800 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    spots = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(spots), len(lines))


def test_measures_match_brute_force(spark, docs, rows, sf_docs):
    extra = ["a b c", "a b c a b c", "# * $ | <>&%", "a b a b a b a", "x\ny\nx\n\n \nx", "é é é é"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(900 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")).union(sf_docs.selectExpr("doc_id + 100000", "text"))
    want = {r.doc_id: brute(r.text) for r in df.collect()}
    led = Q.ledger(df)
    got = {r.doc_id: tuple(r[m] for m in Q.MEASURES) for r in led.collect()}
    assert got == want
    for r in Q.apply_policy(led).collect():
        n = want[r.doc_id]
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and r.kept == (r.rule_bits == 0)


def test_policies_and_ablations_come_from_bits(spark):
    led = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 2), (5, 8)], "doc_id long, rule_bits long")
    assert {r.doc_id for r in Q.apply_policy(led, "base").where("kept").collect()} == {1, 5}
    assert {r.doc_id for r in Q.apply_policy(led, "v1").where("kept").collect()} == {1}
    got = {r.rule: (r.failed, r.only_this, r.kept_without) for r in Q.ablations(led).collect()}
    assert got["few_words"] == (2, 1, 2) and got["symbols"] == (1, 1, 2) and got["long_words"] == (0, 0, 1)


def test_plan_has_no_python_and_no_shuffle(docs, empty, with_null_id):
    plan = Q.apply_policy(Q.ledger(docs.coalesce(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert Q.ledger(empty).count() == 0
    assert [r.n_words for r in Q.ledger(with_null_id).where("doc_id is null").collect()] == [80]


def test_collisions_of_the_short_hash_are_told_apart(spark, monkeypatch):
    """All windows in one hash: the words decide."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(Q.F, "hash", lambda *c: F.lit(1))
    df = spark.createDataFrame([(1, "a b c d e f a b c")], "doc_id long, text string")
    assert Q.ledger(df).first().n_repeat_words == 6


def test_registered_ablations_equal_their_sql(spark, sf, empty):
    import duckdb

    from cairn.llm import queries

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    df = queries.quality_ablations(spark, sf)
    want = con.sql(f"select rule, failed, only_this, kept_without from ({Q.ABLATIONS})").fetchall()
    assert sorted(map(tuple, df.select("rule", "failed", "only_this", "kept_without").collect())) == sorted(want) and any(x[1] for x in want)
    assert {tuple(r)[1:] for r in Q.ablations(Q.ledger(empty)).collect()} == {(0, 0, 0)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_texts(spark):
    t = "word " * 200_000 + "\n" + "a b c " * 1000
    r = Q.ledger(spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")).collect()
    assert [(x.n_words, x.n_repeat_words) for x in r] == [(203_000, 203_000)] * 2
