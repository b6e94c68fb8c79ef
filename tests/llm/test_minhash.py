import numpy as np
from conftest_llm import shingles

from cairn.llm import _kernel as K
from cairn.llm import minhash
from cairn.llm._shared import components


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    least = {i: i for i in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def result(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, **kw).collect()}


def test_edge_cases_match_brute_force(docs, rows):
    assert result(docs, shingle=4) == brute([r[:2] for r in rows], 4)
    assert result(docs) == brute([r[:2] for r in rows], 5)


def test_documents_match_brute_force(sf_docs):
    assert result(sf_docs, shingle=4) == brute([(r.doc_id, r.text) for r in sf_docs.collect()], 4)


def test_links_that_miss_the_hub_are_found(spark):
    """One bucket, two pairs that are alike only with each other."""
    words = [f"v{i}" for i in range(300)]
    rows = []
    for i in range(12):  # a chain: each is near its neighbours only
        rows.append((i, " ".join(words[i * 8 : i * 8 + 100])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, shingle=1, rows=1) == brute(rows, 1)


def test_empty_null_and_repeated(spark, empty, with_null_id):
    assert minhash.near_duplicates(empty).count() == 0
    got = [r for r in minhash.near_duplicates(with_null_id).collect() if r.doc_id is None]
    assert len(got) == 1 and got[0].component_id is None and got[0].kept
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(twice).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_registers_are_those_of_one_element_after_the_other():
    m = 16
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 3, 50, 400)]
    got = minhash.superminhash(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), m)
    for s, g in zip(sets, got):
        h = [2**64 - 1] * m
        for v in s:
            p = list(range(m))
            for j in range(m):
                x = int(K.mix(np.array([(int(v) + 0x9E3779B97F4A7C15 * (j + 1)) % 2**64], np.uint64))[0])
                k = j + (((x & 0xFFFFFFFF) * (m - j)) >> 32)
                p[j], p[k] = p[k], p[j]
                h[p[j]] = min(h[p[j]], (j << 32) | (x >> 32))
        assert h == [int(x) for x in g]


def test_estimate_is_close():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    r = minhash.superminhash(np.concatenate([a, b]), np.array([0, 1000, 2000]), 250)
    assert abs((r[0] == r[1]).mean() - 800 / 1200) < 0.1


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_a_hot_group_of_near_copies_is_one_component(spark):
    """More partners than one salt of a hub takes, all different texts."""
    words = [f"h{i}" for i in range(200)]
    rows = [(i, " ".join(words[:k] + [f"new{i}"] + words[k + 1 :])) for i in range(1200) for k in [i % 200]]
    df = spark.createDataFrame([*rows, (5000, "nothing like the others " * 20)], "doc_id long, text string")
    got = result(df)
    assert {c for i, (_, c, _) in got.items() if i < 5000} == {0} and got[5000][1] == 5000


def test_words_that_sums_of_powers_confuse_are_different(spark):
    x = "a"
    while len(x) < 4096:
        x += x.translate({97: 98, 98: 97})
    rows = [(i, w) for i, n in ((0, 1024), (10, 4096)) for i, w in ((i, x[:n]), (i + 1, x[:n].translate({97: 98, 98: 97})), (i + 2, x[:n]))]
    rows += [(20, "a b c d e f g h " + x), (21, "a b c d e f g h " + x.translate({97: 98, 98: 97}))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, shingle=2) == brute(rows, 2)
    assert result(df, shingle=2)[1] == (1, 1, True)


def test_links_are_confirmed_on_words(monkeypatch):
    """With hashes that tell nothing apart, the words still do."""
    monkeypatch.setattr(K, "grams", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    data = [b"a b c d e", b"a b c d e f", b"p q r s t", b"a b", b"a b", b"p q"]
    x = minhash.Texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 4, True)
    assert x.similar([(0, 1), (0, 2), (3, 4), (3, 5), (0, 3)], 60) == [True, False, True, False, False]


def test_a_hot_bucket_of_a_template(spark):
    """Texts that share half of their shingles, beyond what a bucket looks at pair by pair; some are near copies."""
    template = " ".join(f"t{i}" for i in range(40))
    rows = [(i, template + " " + " ".join(f"d{i // 2 if i % 7 == 1 else i}x{j}" for j in range(30))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3)
    assert len({c for _, c, _ in want.values()}) > 40
    assert result(df, shingle=3, rows=1, most=8) == want
    assert result(df, shingle=3, rows=1) == want


def test_texts_of_one_template_are_not_paired(spark, monkeypatch):
    """Pairs that a template makes half alike aren't looked at one by one, in a bucket of any size."""
    looked = []
    verified = minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *rest: looked.append(pairs.count()) or verified(pairs, *rest))
    template = " ".join(f"t{i}" for i in range(40))
    rows = [(i, template + " " + " ".join(f"d{i // 2 if i % 10 == 1 else i}x{j}" for j in range(12))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, shingle=1, rows=1) == brute(rows, 1)
    assert sum(looked[1:]) < 10 * len(rows)  # all pairs would be 19,900; first come those with the hubs


def test_a_shingle_of_many_members_is_a_grid(spark):
    """Links across the blocks of a shingle, and none lost between them."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i * 7 % 60, " ".join(words[i * 5 : i * 5 + 100])) for i in range(60) if i % 20 != 9 and i % 20 != 10]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 1)
    assert 1 < len({c for _, c, _ in want.values()}) < 10
    assert result(df, shingle=1, rows=1, most=2) == want
    assert result(df, shingle=1, rows=1) == want
