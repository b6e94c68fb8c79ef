import numpy as np

from cairn.llm import urls

URLS = ["http://example.com/en/1", "https://WWW.example.COM/en/x?y#z", "http://a.b.example.com/en/", "http://example.com/fr", "x://net/es/", "http://m.net/es", "http://m.net/fr/#q", "http://com", "http://com?/en/", "no scheme", "", None, "http://", "http:///en/", "http://example.com:80/en/", "http://notexample.com/en/", "http://ÄB.com/é/ü", "://com/", "http://a://com/x"]


def brute(url, rules, default="allow"):
    host, path = urls.split(url)
    fit = [(len(r), r, v) for r, v in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])] if host else []
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, default)


def test_split():
    assert urls.split("http://A.Com/x?y") == ("a.com", "/x") and urls.split("a://b?c/d") == ("b", "") and urls.split("a://b#c") == ("b", "")
    assert urls.split(None) == urls.split("ab/c") == ("", "") and urls.split("http:///en/") == ("", "/en/")


def test_rules_match_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, "http://com/", "x")], "page_id long, url string, rule string")
    more = [*urls.RULES, ("m.net/", "block"), ("com/é/", "block"), ("b.example.com/", "block"), ("example.com/e", "allow")]
    for rules in (urls.RULES, more):
        for bits in (0, 3):
            got = {r.page_id: tuple(r)[1:] for r in urls.judge(df, urls.build(urls.rules_frame(spark, rules), bits)).collect()}
            assert got == {**{i: brute(u, rules) for i, u in enumerate(URLS)}, None: brute("http://com/", rules)}


def test_many_rules_and_no_rules(spark):
    rules = [(f"h{i}.org/p{i % 7}/", "block" if i % 2 else "allow") for i in range(3000)]
    df = spark.createDataFrame([(i, f"http://s.h{i}.org/p{i % 7}/x") for i in range(0, 4000, 7)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(df, urls.build(urls.rules_frame(spark, rules), 4)).collect()}
    assert got == {i: ("block" if i % 2 else "allow") if i < 3000 else "allow" for i in range(0, 4000, 7)}
    none = urls.build(urls.rules_frame(spark, []))
    assert {r.verdict for r in urls.judge(df, none, default="block").collect()} == {"block"}
    assert urls.judge(df.limit(0), none).count() == 0


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda x: 5)
    import pandas as pd

    urls._write(pd.DataFrame({"rule": ["a/", "b/"], "verdict": ["allow", "block"], "shard": [0, 0]}), str(tmp_path))
    index = urls.Index(str(tmp_path), {0: 2}, [1], 0)
    assert list(index.find([b"a/", b"b/", b"c/"])) == [1, 2, 0] and isinstance(index.shard(0)[0], np.memmap)


def test_ties_case_and_shards_from_a_count(spark, monkeypatch):
    rules = [("a.com/", "allow"), ("a.com/", "block"), ("A.com/", "allow"), ("B.Com/X", "block"), ("c.com", "block"), (None, "block"), ("d.com/", None)]
    df = spark.createDataFrame([(1, "x://a.com/"), (2, "x://b.com/X"), (3, "x://b.com/x"), (4, "x://c.com/"), (5, "x://d.com/"), (6, "x://a.com/" + "y" * 100_000)], "page_id long, url string")
    for size in (250_000, 1):
        monkeypatch.setattr(urls, "SHARD_RULES", size)
        index = urls.build(urls.rules_frame(spark, rules).repartition(4))
        assert index.bits == (0 if size > 1 else 1) and sum(index.shards.values()) == 2
        assert {r.page_id: r.rule for r in urls.judge(df, index).collect()} == {1: "a.com/", 2: "b.com/X", 3: None, 4: None, 5: None, 6: "a.com/"}
        assert {r.page_id: r.verdict for r in urls.judge(df, index).collect()}[1] == "block"
