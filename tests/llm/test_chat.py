import json

from cairn.llm import chat

CALL, RESULT = "<tool_call>{}</tool_call>", "<tool_result>{}</tool_result>"
ROWS = [
    (1, 0, "user", 'say "x" \u00e9\n'),
    (1, 1, "assistant", "so " + CALL.format('{"name":"search","id":"a","arguments":{"query":"q","limit":3}}') + CALL.format('{"id":"b","name":"calculate","arguments":{"z":1,"expression":5},"after":["c","a"]}')),
    (1, 2, "tool", RESULT.format('{"id":"a","content":{"y":1,"b":[1,2]}}')),
    (1, 3, "assistant", CALL.format('{"id":"c","name":"nope","arguments":{}}')),
    (1, 0, "tool", RESULT.format('{"id":"c","content":"early"}')),
    (1, 4, "assistant", CALL.format('{"id":"a","name":"search","arguments":{}}')),
    (2, 0, "assistant", CALL.format('{"id":"x","name":"fetch","arguments":{"url":"u","timeout":1.5},"after":["y"]}') + CALL.format('{"id":"y","name":"fetch","arguments":[1],"after":["x"]}')),
    (2, 1, None, None),
    (None, None, "tool", RESULT.format("{bad}")),
    (2, 3, "tool", RESULT.format('{"id":"zz","content":null}')),
]


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, line string")
    return chat.format_chats(df).orderBy("conv_id", "turn", "depth", "part", "line").collect()


def test_links_order_problems_and_canonical_lines(spark):
    got = formatted(spark, ROWS)
    one = [(r.kind, r.status, list(r.problems), r.line) for r in got if r.conv_id == 1 and r.kind != "message"]
    order = [json.loads(line)["id"] + kind[0] for kind, _, _, line in one]
    assert order.index("cc") < order.index("cr") and order.index("cc") < order.index("bc") and order.index("ac") < order.index("ar")
    by = {(k, json.loads(line)["id"], s): (p, line) for k, s, p, line in one}
    assert by["call", "a", "linked"] == ([], '{"arguments":{"limit":3,"query":"q"},"id":"a","name":"search"}')
    assert by["call", "b", "orphan"][0] == ["expression is not string", "unexpected z"]
    assert by["call", "c", "linked"][0] == ["unknown tool nope"]
    assert by["call", "a", "duplicate"][0] == ["missing query"]
    assert by["result", "a", "linked"][1] == '{"content":{"b":[1,2],"y":1},"id":"a"}'
    two = [(r.kind, r.status, list(r.problems)) for r in got if r.conv_id == 2 and r.kind != "message"]
    assert ("call", "cyclic", []) in two and ("call", "cyclic", ["arguments are not an object"]) in two and ("result", "orphan", []) in two
    assert [(r.status, r.line) for r in got if r.conv_id is None and r.kind == "result"] == [("malformed", '{"malformed":"{bad}"}')]
    talk = {r.line for r in got if r.kind == "message"}
    assert {'{"content":"say \\"x\\" é\\n","role":"user"}', '{"content":"so","role":"assistant"}', '{"content":"","role":null}'} <= talk


def test_deep_chains(spark):
    rows = [(1, 9 - i, "assistant", CALL.format(json.dumps({"id": f"c{i}", "name": "fetch", "arguments": {"url": "u"}, "after": [f"c{i - 1}"] if i else []}))) for i in range(10)]
    calls = [json.loads(r.line)["id"] for r in formatted(spark, rows) if r.kind == "call"]
    assert calls == [f"c{i}" for i in range(10)]


def test_native_plan_and_whole_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    out = chat.format_chats(df)
    assert out.where("kind = 'message'").count() == df.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.format_chats(df.limit(0)).count() == 0


def brute(calls):
    """{(conv, id): (turn, depth, cyclic)} of (conv, id, turn, after), one conversation after the other."""
    import sys

    sys.setrecursionlimit(20_000)
    out = {}
    for conv in {c[0] for c in calls}:
        turn = {i: t for c, i, t, _ in calls if c == conv}
        needs = {i: [x for x in after if x in turn] for c, i, _, after in calls if c == conv}
        cyclic = set()
        for i in needs:
            seen, todo = set(), list(needs[i])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += needs[x]
            if i in seen:
                cyclic.add(i)
        memo = {i: (turn[i], 0) for i in cyclic}

        def at(i):
            if i not in memo:
                memo[i] = max([(turn[i], 0), *((t, d + 1) for t, d in map(at, needs[i]))])
            return memo[i]

        for i in needs:
            out[conv, i] = (*at(i), i in cyclic)
    return out


def placed(spark, calls):
    rows = [(c, t, "assistant", CALL.format(json.dumps({"id": i, "name": "fetch", "arguments": {"url": "u"}, "after": after}))) for c, i, t, after in calls]
    return {(r.conv_id, json.loads(r.line)["id"]): (r.turn, r.depth, r.status == "cyclic") for r in formatted(spark, rows) if r.kind == "call"}


def test_cycles_and_long_chains_beside_more_than_a_thousand_dependencies(spark):
    """A chain of 1,500 in one turn, a cycle of 37 and what comes after it, and a cycle of two in other conversations."""
    calls = [(1, f"c{i}", 5, [f"c{i - 1}"] if i else []) for i in range(1500)]
    calls += [(2, f"r{i}", i % 3, [f"r{(i + 1) % 37}"]) for i in range(37)] + [(2, "then", 2, ["r0", "r5"]), (2, "before", 0, [])]
    calls += [(3, "x", 0, ["y"]), (3, "y", 0, ["x"]), (4, "self", 0, ["self"])]
    calls += [(5, f"m{i}", i % 5, [f"m{j}" for j in (i - 1, i // 2, i - 7) if 0 <= j < i]) for i in range(62)]
    got = placed(spark, calls)
    assert got == brute(calls)
    assert got[1, "c1499"] == (5, 1499, False) and got[3, "x"] == got[3, "y"] == got[4, "self"] == (0, 0, True)
    assert got[2, "then"] == (2, 1, False) and sum(c for *_, c in got.values()) == 40


def test_rows_and_joins_order_alike(spark, monkeypatch):
    """Random graphs, with cycles: ordered in rows, and, as if they were large, by joins."""
    import random

    r = random.Random(6)
    calls = [(c, f"k{i}", r.randint(0, 4), [f"k{r.randint(0, n)}" for _ in range(r.randint(0, 2))]) for c in range(12) for n in [r.randint(1, 12)] for i in range(n)]
    want = brute(calls)
    assert any(x[2] for x in want.values()) and placed(spark, calls) == want
    monkeypatch.setattr(chat, "SMALL", 3)
    assert placed(spark, calls) == want


def test_equal_identifiers_in_one_turn_are_told_apart(spark):
    """Other texts of one turn, repeated rows, and a repeated block in one text: one block is the first."""
    call = lambda x: CALL.format(json.dumps({"id": "a", "name": "fetch", "arguments": {"url": x}}))
    rows = [(1, 0, "assistant", call("v")), (1, 0, "assistant", call("u")), (2, 3, "assistant", call("u")), (2, 3, "assistant", call("u")), (2, 3, "assistant", call("u")), (3, 0, "assistant", call("u") + call("u"))]
    got = [(r.conv_id, r.status, json.loads(r.line)["arguments"]["url"]) for r in formatted(spark, rows) if r.kind == "call"]
    assert sorted(got) == [(1, "duplicate", "v"), (1, "orphan", "u"), (2, "duplicate", "u"), (2, "duplicate", "u"), (2, "orphan", "u"), (3, "duplicate", "u"), (3, "orphan", "u")]


def test_long_texts_and_empty_table(spark):
    long = "word " * 300_000
    got = formatted(spark, [(1, 0, "user", long + CALL.format('{"id":"a","name":"fetch","arguments":{"url":"u"}}') + long)])
    assert [r.kind for r in got] == ["message", "call"] and len(got[0].line) > 3_000_000
    assert formatted(spark, [(1, 0, "user", None)])[0].line == '{"content":"","role":"user"}'


def test_registered_query_covers_links_order_and_validation(spark, sf):
    """Every status, many depths and problems occur in the registered table, and SQL gives the same rows."""
    import duckdb

    from cairn.llm import queries

    df = queries.op7_chat_format(spark, sf)
    got = sorted(map(tuple, df.select("conv_id", "turn", "depth", "part", "kind", "status", "problems", "line").collect()))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.sql(f"select conv_id, turn, depth, part, kind, status, problems, line from ({chat.ORACLE})").fetchall()
    assert got == sorted(want)
    assert {(r[4], r[5]) for r in got} >= {("call", s) for s in ("linked", "orphan", "duplicate", "cyclic")} | {("result", s) for s in ("linked", "orphan", "malformed")}
    assert max(r[2] for r in got) >= 2 and len({r[6] for r in got}) >= 8
