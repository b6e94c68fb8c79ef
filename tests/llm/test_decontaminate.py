from conftest_llm import shingles

from cairn.llm import decontaminate


def brute(docs, items, k=5, percent=80):
    d = {i: shingles(t, k) for i, t in docs}
    out = {}
    for j, t in items:
        s = shingles(t, k)
        for i, x in d.items():
            if s and 100 * len(s & x) >= percent * len(s):
                out[i, j] = (len(s), len(s & x))
    return out


def pairs(df, items, **kw):
    return {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in decontaminate.contained_items(df, items, **kw).collect()}


def test_edge_cases_match_brute_force(spark, docs, rows):
    base = next(r[1] for r in rows if r[0] == 7).split()
    items = [(1, None), (2, ""), (3, "one"), (4, "ONE two three"), (5, " ".join(base[10:40])), (6, " ".join(base[10:40])), (7, " ".join([*base[20:50], "else", "where"])), (8, "not there at all in any of them"), (9, "same same same same same same"), (10, " ".join(base))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = brute([r[:2] for r in rows], items)
    assert want and pairs(docs, frame) == want
    assert pairs(docs, frame, block_bytes=200) == want  # many blocks
    clean = decontaminate.drop_contaminated(docs, frame, block_bytes=200)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {i for i, _ in want}


def test_documents_match_brute_force(spark, sf, sf_docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in sf_docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and pairs(sf_docs, items) == want


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(docs, none).count() == 0
    assert decontaminate.contained_items(empty, none).count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()


def test_full_sized_blocks_and_long_items(spark, tmp_path):
    """Items over a block of 16 MiB: an index of at most 100 MB, exact for items of a few and of thousands of words."""
    import os
    import random

    import numpy as np
    import pyarrow as pa

    r = random.Random(11)
    vocab = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(i, text(n)) for i, n in enumerate([30] * 20_000 + [2500] * 500 + [4, 5, 17, 1200])]
    total = sum(len(t) for _, t in items)
    assert total >= 0.8 * decontaminate.BLOCK_BYTES
    docs = []
    for i, j in enumerate([0, 7, 19_999, 20_000, 20_100, 20_499, 20_500, 20_501, 20_502, 20_503]):
        w = items[j][1].split()
        docs += [(10 * i, text(40) + " " + items[j][1].upper() + " " + text(9)), (10 * i + 1, " ".join(w[: int(len(w) * 0.9)])), (10 * i + 2, " ".join(w[: len(w) // 2]))]
    docs.append((500, items[20_500][1]))
    made = decontaminate._write(pa.table({"i": [i for i, _ in items], "t": [t for _, t in items]}), str(tmp_path), 5, 80, 16)
    path = made.column("path")[0].as_py()
    assert sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path)) < 100 << 20
    block = decontaminate.Block(path, 5, 80)
    data = [t.encode() for _, t in docs]
    got = block.search(decontaminate.Slice(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 5))
    some = [items[j] for j in {j for _, j, _ in got} | {0, 7, 19_999, 20_000, 20_100, 20_499, 20_500, 20_501, 20_502, 20_503, 1, 2}]
    want = brute(docs, some)
    assert {(docs[d][0], i): s for d, i, s in got} == {k: s for k, (_, s) in want.items()} and len(want) >= 18


def test_one_hash_for_all_shingles(monkeypatch):
    """Words decide where hashes collide."""
    import numpy as np

    monkeypatch.setattr(decontaminate.K, "grams", lambda h, k: np.full(max(0, len(h) - k + 1), 3, np.uint64))
    items, docs = [(1, "a b c d e f g"), (2, "a b c d e"), (None, "p q r s t u")], [(1, "x a b c d e f g y"), (2, "b c d e f"), (3, "p q r s t u a b c d e")]
    arrays = decontaminate.index([i for i, _ in items], [t for _, t in items], 5, 80, 16)
    assert [int(x) for x in np.diff(arrays["cuts"])] == [3, 1, 2]
    block = decontaminate.Block.__new__(decontaminate.Block)
    block.k, block.percent, block.bits = 5, 80, int(np.log2(len(arrays["seen"])))
    for name, a in arrays.items():
        setattr(block, name, a)
    block.need = np.ones(3, np.int64)  # hits count hashes, of which there is one
    data = [t.encode() for _, t in docs]
    got = block.search(decontaminate.Slice(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 5))
    assert {(docs[d][0], items[i][0]): s for d, i, s in got} == {k: s for k, (_, s) in brute(docs, items).items()}


def test_no_items_and_odd_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (None, "a b c d e f", "y")], "doc_id long, text string, path string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(docs, none).count() == 0 and decontaminate.drop_contaminated(docs, none).count() == 2
    item = spark.createDataFrame([(None, "B c D e f")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.n_item) for r in decontaminate.contained_items(docs, item).orderBy("doc_id").collect()] == [(None, None, 1), (1, None, 1)]
