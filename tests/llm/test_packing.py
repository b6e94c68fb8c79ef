import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import packing

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def check(df, rows, capacity=1024):
    got = packing.pack(df, PATH, capacity=capacity).collect()
    tok = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert len(by_doc) == len(rows)
    for i, text in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert n == 0 or r.length == capacity
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), sum(r.length for r in got)


def test_edge_cases_round_trip(docs, rows):
    n, total = check(docs, [r[:2] for r in rows])
    assert n <= -(-total // 1024) + 2
    check(docs, [r[:2] for r in rows], capacity=64)


def test_documents_round_trip(sf_docs):
    n, total = check(sf_docs, [(r.doc_id, r.text) for r in sf_docs.collect()])
    assert n <= 1.03 * total / 1024 + 1


def test_empty_table_and_null_id(spark, empty):
    assert packing.pack(empty, PATH).count() == 0
    r = packing.pack(spark.createDataFrame([(None, None)], "doc_id long, text string"), PATH).collect()
    assert [(x.doc_id, x.length, x.offset) for x in r] == [(None, 1, 0)]


def test_both_encoders_agree():
    e = packing.Encoder(PATH)
    for t in ["", "it's  we'll\n\n x", "naïve 東京   12ab--!!", "\t\ta b\r\n", "'s's", "<|endoftext|> a", "🙂👍🏽"]:
        assert e.ids(t) == e.slow.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=20, max_size=20))
def test_slots_use_every_piece_once(counts):
    c = np.array([0, *counts])
    slots = packing.solve(c, 20)
    used, bins = defaultdict(int), defaultdict(list)
    for length, r0, r1, s, at in slots:
        assert r0 == used[length]
        used[length] = r1
        for k in range(r1 - r0):
            bins[s + k].append((at, length))
    assert all(used[n] == c[n] for n in range(1, 21))
    for b in bins.values():
        end = 0
        for at, length in sorted(b):
            assert at == end
            end += length
        assert end <= 20


def test_exact_complements_leave_no_gap():
    c = np.zeros(101, int)
    c[[60, 40, 50, 30, 20, 70, 10, 80, 5, 15]] = [4, 4, 2, 2, 2, 3, 3, 1, 2, 1]
    slots = packing.solve(c, 100)
    total = int((np.arange(101) * c).sum())
    assert len({s + k for _, a, b, s, _ in slots for k in range(b - a)}) == -(-total // 100)


def test_every_way_begins_with_complements():
    """Where an exact single complement exists, each way uses it before any residual."""
    c = np.zeros(101, int)
    c[[60, 40, 35, 25]] = [3, 3, 1, 1]
    for parts, even in ((1, False), (2, False), (2, True), (3, False), (3, True)):
        patterns = packing._patterns(c, 100, parts, even)
        assert patterns[0] == ((60, 40), 3) and sum(k for _, k in patterns) == 4


def test_real_lengths_come_within_a_percent_of_the_bound():
    r = np.random.default_rng(5)
    for n in (200, 2000):
        lengths = np.clip(r.lognormal(5.3, 1.1, n).astype(int), 1, 20_000)
        c = np.zeros(1025, np.int64)
        for x in lengths:
            c[1024] += x // 1024
            c[x % 1024] += x % 1024 > 0
        got = packing.solve(c, 1024)
        bound = -(-int((np.arange(1025) * c).sum()) // 1024)
        assert len({s + k for _, a, b, s, _ in got for k in range(b - a)}) <= bound * 1.01 + 1
