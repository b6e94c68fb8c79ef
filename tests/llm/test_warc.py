import gzip
import hashlib

import pytest

from cairn.llm import warc
from cairn.llm._shared import local_path, scratch

BIG = "<p>é\r\n\r\nWARC/1.1</p>" * 40
PAGES = [(1, "http://a/", BIG), (2, None, BIG), (3, "http://b/\r\nX: y", None), (4, "", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "x" * 100), (8, "u", "x" * 100), (9, "u", "y" * 99), (10, "u", "y" * 99), (0, "u", BIG), (None, "u", BIG), (11, "u", "long" * 200_000)]


def brute(rows):
    out = {}
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, k in rows if k == h and j is not None]
        again = len(p) >= 100 and i is not None and min(same) != i
        out[i] = (len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", min(same) if again else None)
    return out


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "clash") for r in PAGES], "page_id long, url string, html string, refers_to string").repartition(3)


def test_round_trip(spark, pages):
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == brute(PAGES)


def test_payloads_urls_and_rolling(spark, pages):
    paths = warc.write(pages, scratch(spark, "warc"), roll=500)
    assert paths.count() > 4
    got = {r.page_id: r for r in warc.read_archives(paths, with_payload=True).collect()}
    assert {i for i in got} == {r[0] for r in PAGES}
    assert all(bytes(got[i].payload) == (h or "").encode() for i, _, h in PAGES if got[i].record_type == "response")
    assert got[3].url == "http://b/X: y"
    for r in paths.collect():
        assert gzip.open(r.path).read().startswith(b"WARC/1.1\r\n")


def test_empty_table_and_repeated_ids(spark, pages):
    assert warc.round_trip(pages.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "u", BIG), (1, "u", BIG), (2, "u", BIG)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type) for r in warc.round_trip(twice).collect())
    assert got == [(1, "response"), (1, "response"), (2, "revisit")]


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_reader_frames_and_verifies(tmp_path, block):
    p = tmp_path / "a.warc.gz"
    parts = [warc.record(1, "u", b"abc", None), warc.record(2, "u", b"", None), warc.record(3, "u", b"abc", 1)]
    p.write_bytes(b"".join(parts))
    assert [(h["WARC-Type"], b) for h, b in warc.read(str(p), block)] == [("response", b"abc"), ("response", b""), ("revisit", b"")]
    bad = {
        "cut off": b"".join(parts)[:-5],
        "digest differs": gzip.compress(gzip.decompress(parts[0]).replace(b"abc", b"abd")),
        "as long as": gzip.compress(gzip.decompress(parts[0]).replace(b"abc", b"ab")),
        "begins the record": gzip.compress(b"HTTP/1.1\r\n\r\n"),
    }
    for why, data in bad.items():
        p.write_bytes(data)
        with pytest.raises(warc.WarcError, match=why):
            list(warc.read(str(p), block))


def test_shared_folder_must_be_mounted():
    with pytest.raises(ValueError):
        local_path("s3a://bucket/x")


def test_headers_are_those_of_the_format(tmp_path):
    p = tmp_path / "a.warc.gz"
    p.write_bytes(warc.record(1, "http://a/", b"x" * 200, None, "2024-01-02T03:04:05Z") + warc.record(2, None, b"x" * 200, 1) + warc.record(None, "", b"", None))
    one, two, three = (h for h, _ in warc.read(str(p)))
    for h in (one, two, three):
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Length"} <= set(h) and h["WARC-Record-ID"].startswith("<urn:uuid:")
    assert one["WARC-Date"] == "2024-01-02T03:04:05Z" and two["WARC-Refers-To"] == one["WARC-Record-ID"] != two["WARC-Record-ID"]
    assert two["WARC-Profile"].endswith("identical-payload-digest") and "WARC-Profile" not in one and two["WARC-Target-URI"] == "urn:page:2"


def test_revisits_are_verified(spark):
    rows = [(1, 200, "aa", "response", None), (2, 200, "aa", "revisit", 1)]
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    warc.verify(spark.createDataFrame(rows, kind))
    for bad in ((3, 200, "bb", "revisit", 1), (3, 201, "aa", "revisit", 1), (3, 200, "aa", "revisit", 2)):
        with pytest.raises(warc.WarcError, match="refers to page"):
            warc.verify(spark.createDataFrame([*rows, bad], kind))
