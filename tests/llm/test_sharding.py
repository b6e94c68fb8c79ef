import hashlib

import pytest

from cairn.llm import sharding


def brute(rows, limit):
    bits = {i: bin(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16))[2:].zfill(60) for i, _ in rows}
    size = lambda i_t: len((i_t[1] or "").encode())
    out = {}

    def split(group, depth):
        total = sum(map(size, group))
        if total <= limit or depth == 60:
            for i, _ in group:
                out[i] = (bits[i][:depth], depth, total, total > limit)
        else:
            for b in "01":
                split([g for g in group if bits[g[0]][depth] == b], depth + 1)

    split(rows, 0)
    return out


def result(df, limit):
    return {r.doc_id: (r.shard, r.depth, r.shard_bytes, r.oversized) for r in sharding.shards(df, limit=limit).collect()}


def test_buckets_match_recursion(docs, rows, sf_docs):
    rows = [r[:2] for r in rows]
    for limit in (10**9, 5000, 1200, 100):
        assert result(docs, limit) == brute(rows, limit)
    assert result(sf_docs, 20_000) == brute([(r.doc_id, r.text) for r in sf_docs.collect()], 20_000)


def test_empty_null_and_written(spark, docs, empty, with_null_id, tmp_path):
    assert sharding.shards(empty).count() == 0
    assert sharding.shards(with_null_id, limit=1000).count() == with_null_id.count()
    sharding.write_shards(with_null_id, f"file://{tmp_path}/s", limit=1500)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == with_null_id.count() and set(with_null_id.columns) <= set(back.columns)


def test_repeated_ids_are_marked(spark):
    df = spark.createDataFrame([(1, "x" * 60), (1, "y" * 60), (2, "z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.oversized) for r in sharding.shards(df, limit=100).collect())
    assert got == [(1, True), (1, True), (2, False)]


def test_columns_may_have_any_name(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 50, "mine", 7) for i in range(20)], "doc_id long, text string, shard string, of int")
    with pytest.raises(ValueError):
        sharding.write_shards(df, f"file://{tmp_path}/a", limit=200)
    sharding.write_shards(df, f"file://{tmp_path}/b", limit=200, shard_col="part")
    back = spark.read.parquet(f"file://{tmp_path}/b")
    assert back.where("shard = 'mine' and of = 7").count() == 20 and back.select("part").distinct().count() >= 5


def test_the_registered_limit_splits(spark):
    """Also where one document is over the limit."""
    rows = [(i, "x" * 60_000) for i in range(40)] + [(99, "y" * 600_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(df, sharding.LIMIT)
    assert got == brute(rows, sharding.LIMIT) and got[99][3] and len({s for s, *_ in got.values()}) > 5
