import zlib

import numpy as np
import pytest

from cairn.llm import toxicity as T


def test_held_out_accuracy_and_columns(spark, sf, sf_docs):
    """Trained on sf0.01's labels; held-out rows decide."""
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    got = T.score(docs, T.fit(docs, labels)).collect()
    assert len(got) == docs.count()
    y = {r.doc_id: r.toxic for r in labels.collect()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [(r.score, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    a, b = (np.array([s for s, t in test if t == k]) for k in (1, 0))
    assert (a[:, None] > b[None]).mean() > 0.8


def test_labels_of_held_out_rows_are_never_read(spark, sf_docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    assert T.sample(sf_docs, labels, "doc_id", "text", "toxic", 100) == T.sample(sf_docs, flipped, "doc_id", "text", "toxic", 100)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    plain = [f"plain{i}" for i in range(300)]
    texts, y = [], []
    for i in range(600):
        words = list(rng.choice(plain, 60))
        if i % 4 == 0:
            words[int(rng.integers(60))] = ["villain", "knave"][i // 4 % 2]
        texts.append(" ".join(" ".join(words[j : j + 10]) + "." for j in range(0, 60, 10)))
        y.append(int(i % 4 == 0))
    return T.train(texts, y)


def test_offending_sentences_are_located(spark, model):
    text = "Ça plain1 plain2. Ü you Villain, plain5! plain7 plain8.\nplain9"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "plain1. " * 5000), (5, "plain1 knave")], "doc_id long, text string")
    got = {r.doc_id: r for r in T.score(df, model).collect()}
    assert [text[s.begin : s.end] for s in got[1].offending] == ["Ü you Villain, plain5"]
    assert got[1].predicted == got[5].predicted == 1
    assert got[2].score == got[3].score == 0 and got[2].n_sentences == 0
    assert got[4].predicted == 0 and got[4].n_sentences == 5000
    assert {r.doc_id for r in T.drop_toxic(df, model).collect()} == {2, 3, 4}


def test_the_number_of_plain_sentences_never_makes_a_document_toxic(spark, model):
    """Also of sentences whose only feature has lost its weight."""
    plain = "plain1 plain2. " * 100_000
    df = spark.createDataFrame([(1, plain), (2, plain + "you knave."), (3, "\n".join(["plain3"] * 100_000))], "doc_id long, text string")
    got = {r.doc_id: r for r in T.score(df, model).collect()}
    assert [got[i].n_sentences for i in (1, 2, 3)] == [100_000, 100_001, 100_000]
    assert max(got[1].score, got[3].score) < 5e-5 and got[1].predicted == got[3].predicted == 0
    assert got[2].predicted == 1 and len(got[2].offending) == 1
    assert {r.doc_id for r in T.drop_toxic(df, model).collect()} == {1, 3}
    dull = T.Model(model.keys, np.zeros(len(model.keys)), model.bias)
    assert max(r.score for r in T.score(df, dull).collect()) < 5e-5


def test_noisy_or_is_one_minus_the_product():
    p, doc = np.array([0.5, 0.5, 0.2]), np.array([0, 0, 2])
    assert np.allclose(T.noisy_or(p, doc, 3), [0.75, 0, 0.2])


def test_degenerate_inputs(spark, docs, empty, with_null_id):
    none = T.train(["a b c"], [0])
    assert {r.score for r in T.score(docs, none).collect()} == {0.0}
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score(empty, T.fit(empty, labels)).count() == 0
    odd = spark.createDataFrame([(None, 1), (7, None), (7, 1), (7, 1)], "doc_id long, toxic int")
    got = T.score(with_null_id, T.fit(docs, odd)).collect()
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert T.drop_toxic(docs, none).columns == docs.columns


def test_held_out_accuracy_on_more_labels(spark, sf):
    docs, labels = (spark.read.parquet(sf.replace("0.001", "0.1") + f"/{n}.parquet") for n in ("documents", "labels"))
    y = {r.doc_id: r.toxic for r in labels.collect()}
    got = [(r.score, r.predicted, y[r.doc_id]) for r in T.score(docs, T.fit(docs, labels)).where("held_out").collect() if r.doc_id in y]
    a, b = (np.array([s for s, _, t in got if t == k]) for k in (1, 0))
    assert (a[:, None] > b[None]).mean() + 0.5 * (a[:, None] == b[None]).mean() > 0.95
    caught, wrong = sum(p for _, p, t in got if t == 1), sum(p for _, p, t in got if t == 0)
    assert caught >= 0.85 * len(a) and wrong <= 0.02 * len(b)


def test_training_matches_plain_loops():
    """The same steps, one instance and one document after the other."""
    import math
    import random

    r = random.Random(4)
    features, docs = 7, 25
    y = [int(r.random() < 0.4) for _ in range(docs)]
    bags = [[sorted(r.sample(range(features), r.randint(0, 3))) for _ in range(r.randint(0, 4))] for _ in range(docs)]
    prior, bias = [r.uniform(0, 4) for _ in range(features)], -4.0
    w, m, v = list(prior), [0.0] * features, [0.0] * features
    for t in range(1, 31):
        grad = [0.05 * (a - b) for a, b in zip(w, prior)]
        for d, bag in enumerate(bags):
            live = [x for x in bag if x]
            p = [1 / (1 + math.exp(-(bias + sum(w[f] for f in x)))) for x in live]
            whole = min(1, max(1e-9, 1 - math.prod(1 - q for q in p)))
            for x, q in zip(live, p):
                for f in x:
                    grad[f] += q * (1 - y[d] / whole)
        for f in range(features):
            g = grad[f] / docs
            m[f], v[f] = 0.9 * m[f] + 0.1 * g, 0.99 * v[f] + 0.01 * g * g
            w[f] -= 0.1 * (m[f] / (1 - 0.9**t)) / (math.sqrt(v[f] / (1 - 0.99**t)) + 1e-8)
    flat = [(d, x) for d, bag in enumerate(bags) for x in bag]
    inst = np.array([i for i, (_, x) in enumerate(flat) for _ in x])
    feat = np.array([f for _, x in flat for f in x])
    live = np.array([bool(x) for _, x in flat])
    got = T.descend(inst, feat, live, np.array([d for d, _ in flat]), np.array(y, float), docs, np.array(prior), bias, 30)
    assert np.allclose(got, w, rtol=1e-9)


def test_scores_match_plain_loops(spark, model):
    """A sentence's logistic and a document's noisy-or, from the model's weights by their keys."""
    import math
    import re

    weights = dict(zip(model.keys.tolist(), model.weights.tolist()))
    key = lambda w, extra=0: int(T.K.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) + extra

    def features(w):
        yield key(w)
        for n in T.PREFIXES:
            if len(w) > n:
                yield int(T.K.mix(np.array([(key(w[:n]) + n) % 2**64], np.uint64))[0])

    texts = ["plain1 villain plain2. knave knave! plain3", "plain4 plain5", "", "a villainous plain9\nKNAVE?", "villain. plain1. villain."]
    want = []
    for t in texts:
        sentences = [w for s in re.split(r"[.!?\n]", t.lower()) if (w := re.findall(r"[0-9a-z]+", s))]
        p = [1 / (1 + math.exp(-z)) if z > model.bias else 0.0 for z in (model.bias + sum(weights.get(f, 0.0) for w in s for f in features(w.encode())) for s in sentences)]
        n = len(sentences)
        want.append(max(1 - math.prod(1 - q for q in p), n / (n + 1) / (1 + math.exp(-model.bias))))
    got = T.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in got], want, atol=1e-9)
    assert got[0].score > 0.3 > got[1].score


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * (100_000 if i == 3 else 10)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    all_, _ = T.sample(docs, labels, "doc_id", "text", "toxic", 1000)
    few, _ = T.sample(docs, labels, "doc_id", "text", "toxic", 1000, most_bytes=260)
    assert len(few) == 5 and sum(map(len, few)) <= 260 and sum(map(len, all_)) > 500_000
    assert len(T.sample(docs, labels, "doc_id", "text", "toxic", 7)[0]) == 7


def test_near_copies_count_once():
    """A text in a hundred copies with one word changed doesn't teach its words; texts that share a third do."""
    body = [f"b{i}" for i in range(400)]
    texts = [" ".join([*body[:i], f"new{i}", *body[i + 1 :]]) for i in range(80)] + [f"plain{i} plain{i + 1} plain{i + 2} plain{i + 3} plain{i + 4} plain{i + 5}" for i in range(80)]
    assert not len(T.train(texts, [1] * 80 + [0] * 80).keys)
    own = [" ".join([*body[:30], *(f"o{i}x{j}" for j in range(60))]) for i in range(40)]
    assert len(T.train(own + texts[80:], [1] * 40 + [0] * 80).keys)
