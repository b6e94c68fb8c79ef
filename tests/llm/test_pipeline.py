import importlib

import corpus_pipeline as P
from conftest_llm import shingles
from test_packing import check
from test_substring import brute as removed

from cairn.llm import decontaminate, minhash, toxicity


def test_stages_take_effect(spark, sf, sf_docs):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    stage = dict(P.STAGES)
    docs = sf_docs.cache()
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    one = stage["toxicity"](spark, docs, sf)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect()} - bad
    two = stage["near_dedup"](spark, docs, sf)
    kept = {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == kept
    three = stage["substring_dedup"](spark, docs, sf)
    want = removed([(r.doc_id, r.text) for r in docs.collect()])
    from conftest_llm import WORD

    rows = three.collect()
    assert three.columns == docs.columns and {r.doc_id: WORD.findall(r.text) for r in rows} == {i: w[3] for i, w in want.items()}
    assert all(r.n_chars == len(r.text) for r in rows)
    four = stage["decontamination"](spark, docs, sf)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.contained_items(docs, items).collect()}
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} == {r.doc_id for r in docs.collect()} - hit
    assert hit and any(shingles(r.text, 5) for r in rows)


def test_edge_rows_pass_every_stage(spark, sf, docs, empty, with_null_id):
    for frame in (docs, empty, with_null_id):
        for _, f in P.STAGES[:-1]:
            out = f(spark, frame, sf)
            assert out.columns == frame.columns
            out.write.format("noop").mode("overwrite").save()


def test_run_packs_what_the_stages_keep(spark, sf):
    out = P.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in P.STAGES[:-1]:
        docs = f(spark, docs, sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in out.collect()} == {i for i, _ in rows}
    check(docs, rows)


def test_entry_lists_all(spark):
    e = importlib.import_module("__spark_entry__")
    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {n.split("_")[0] + "_" for n in names if n.startswith("op")} and "pipeline" in names
    assert set(e.oracle_sql()) <= names
