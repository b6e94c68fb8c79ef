import hashlib

import numpy as np
import pytest
from conftest_llm import WORD

from cairn.llm import substring


def brute(rows, window=50):
    words = {i: WORD.findall(t or "") for i, t in rows}
    least = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            least.setdefault(tuple(words[i][j : j + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if least[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("group_bytes", [8 << 20, 1])
def test_edge_cases_match_brute_force(docs, rows, group_bytes):
    """With one byte a group every anchor is hot, and all suffixes are split by a prefix of the whole window."""
    want = brute([r[:2] for r in rows])
    got = {r.doc_id: r for r in substring.remove_repeats(docs, group_bytes=group_bytes).collect()}
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == {i: w[:3] for i, w in want.items()}
    cut = substring.cut_repeats(docs, group_bytes=group_bytes)
    assert cut.schema == docs.schema
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert all(WORD.findall(t or "") == want[i][3] for i, t in texts.items())
    assert texts[1] is None and texts[3] == " \t\n "


def test_maximal_repeats_match_brute_force(sf_docs):
    words = {r.doc_id: WORD.findall(r.text or "") for r in sf_docs.collect()}
    least, want = {}, set()
    for i in sorted(words):
        for j in range(len(words[i]) - 49):
            least.setdefault(tuple(words[i][j : j + 50]), i)
    for i, w in words.items():
        hit = [least[tuple(w[j : j + 50])] < i for j in range(len(w) - 49)]
        for j, x in enumerate(hit):
            if x and (j == 0 or not hit[j - 1]):
                k = next((k for k in range(j, len(hit)) if not hit[k]), len(hit))
                want.add((i, j, k - j + 49))
    assert want and {(r.doc_id, r.first, r.n_words) for r in substring.maximal_repeats(sf_docs).collect()} == want


@pytest.mark.parametrize("group_bytes", [8 << 20, 1])
def test_words_that_sums_of_powers_confuse_are_different(spark, group_bytes):
    """Thue-Morse words and their complements have the same polynomial hash modulo 2**64, whatever its base."""
    x = "a"
    while len(x) < 4096:
        x += x.translate({97: 98, 98: 97})
    for n in (1024, 4096):
        a, b = x[:n], x[:n].translate({97: 98, 98: 97})
        own = lambda w, k: " ".join([*(f"s{i}" for i in range(30)), w, *(f"s{i}" for i in range(30, 59)), f"end{k}"])  # noqa: B023, E731
        rows = [(1, own(a, 1)), (2, own(b, 2)), (3, own(a, 3))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df, group_bytes=group_bytes).collect()}
        assert got == {i: w[:3] for i, w in brute(rows).items()} and got[2][1] == 0 and got[3][1] == 60


def test_rows_of_one_id_are_told_apart(spark):
    """Rows with equal ids and different words: each loses what an earlier id has, and nothing else."""
    t, u = " ".join(f"q{i}" for i in range(80)), " ".join(f"u{i}" for i in range(90))
    df = spark.createDataFrame([(1, t), (2, t + " tail"), (2, u), (2, u), (3, u + " x"), (3, "y " + t)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect()) == [(1, 80, 0), (2, 81, 80), (2, 90, 0), (2, 90, 0), (3, 81, 80), (3, 91, 90)]


def test_a_long_text_of_one_word(spark):
    df = spark.createDataFrame([(1, "same " * 60), (2, "same " * 200_000), (3, "other " * 70)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect()) == [(1, 60, 0), (2, 200_000, 200_000), (3, 70, 0)]


def test_columns_may_have_any_name(spark):
    t = " ".join(f"q{i}" for i in range(80))
    df = spark.createDataFrame([(1, t, 1, 2, 3, 4), (2, t + " z", 1, 2, 3, 4)], "doc_id long, text string, marks int, c0 int, row int, cut int")
    out = substring.cut_repeats(df)
    assert out.columns == df.columns and sorted(out.collect())[1] == (2, "z", 1, 2, 3, 4)


def test_documents_match_brute_force(sf_docs):
    want = brute([(r.doc_id, r.text) for r in sf_docs.collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(sf_docs).collect()}
    assert got == {i: w[:3] for i, w in want.items()}


def test_short_windows_match_brute_force(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, window=12, gram=3).collect()}
    assert got == {i: w[:3] for i, w in brute([r[:2] for r in rows], 12).items()}


def test_empty_null_and_repeated(spark, empty, with_null_id):
    assert substring.remove_repeats(empty).count() == 0
    assert [r.n_removed for r in substring.remove_repeats(with_null_id).collect() if r.doc_id is None] == [0]
    t = " ".join(f"q{i}" for i in range(80))
    twice = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring.remove_repeats(twice).collect()) == [(1, 0), (1, 0), (2, 80)]


def test_tree_is_that_of_sorted_suffixes():
    r = np.random.default_rng(3)
    for size, letters in ((300, 2), (60, 1), (200, 30), (1, 1)):
        ids = r.integers(0, letters, size).astype(np.int64)
        bounds = np.array(sorted({0, size // 3, size // 2, size}))
        order, depth = substring.suffix_tree(ids, bounds)
        stop = np.repeat(bounds[1:], np.diff(bounds))
        suffix = [tuple(ids[i : stop[i]]) for i in range(size)]
        assert [suffix[i] for i in order] == sorted(suffix)
        for a, b, d in zip(order, order[1:], depth[1:]):
            x, y = suffix[a], suffix[b]
            assert d == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
