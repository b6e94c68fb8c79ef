"""Chat formatting with tool-call linking, in DataFrame functions only.

Messages may carry blocks, ``<tool_call>{"id", "name", "arguments", "after"}</tool_call>`` and
``<tool_result>{"id", "content"}</tool_result>``. Calls and results are hash-joined by (conversation,
identifier); only messages that have blocks take part in any join. Order is topological: a result
comes after its call and a call after the calls that ``after`` names, wherever they stood; what has
no such constraint keeps its turn. A conversation of few constrained calls is ordered within its row;
where there are more, depths come from repeated joins over the constraints alone, until
none is open: chains halve each round, elsewhere a round settles a layer. Arguments are validated against the schemas of the known tools (required keys, types
of properties, unknown keys). Every item is serialised as canonical JSON: sorted keys, no spaces.

A conversation is never collected: each message, call and result is a row with its sort key
(turn, depth, part), so one conversation may hold any share of all rows. Of calls with the same
identifier in a conversation the first (least turn, then place in its text, then the block's own text)
counts, the others are duplicates; the same holds for results. Of wholly equal blocks one is the first.

Edge cases: null text is an empty message; very long texts are searched whole; an empty table gives no
rows; repeated rows are messages of their own, their blocks duplicates; extra columns of any name are
ignored; a block whose JSON doesn't parse, or has no identifier, is
malformed; a call without a result, or a result without a call, is an orphan; the members of a cycle of
``after`` keep their turns and are marked cyclic, calls that name them come after them; a null role is written as null; null conversations or turns link with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, drop

TOOLS: dict[str, dict] = {
    "search": {"properties": {"query": "string", "limit": "integer"}, "required": ["query"]},
    "calculate": {"properties": {"expression": "string"}, "required": ["expression"]},
    "fetch": {"properties": {"url": "string", "timeout": "number"}, "required": ["url"]},
}
_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE"], "boolean": ["BOOLEAN"]}
CALL, RESULT = r"(?s)<tool_call>(.*?)</tool_call>", r"(?s)<tool_result>(.*?)</tool_result>"


def canonical(json: Column) -> Column:
    """JSON with sorted keys and without spaces; null where it doesn't parse."""
    return F.to_json(F.try_parse_json(json))


def _field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "string")


def validate(name: Column, arguments: Column, tools: dict[str, dict] | None = None) -> Column:
    """An array of what is wrong with arguments (a variant); empty where nothing is."""
    tools = TOOLS if tools is None else tools
    none = F.array().cast("array<string>")
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    keys = F.coalesce(F.json_object_keys(F.to_json(arguments)), none)
    for tool, schema in tools.items():
        found = [F.when(~F.array_contains(keys, k), F.lit(f"missing {k}")) for k in schema.get("required", [])]
        for k, kind in schema["properties"].items():
            typed = F.schema_of_variant(F.try_variant_get(arguments, f"$.{k}", "variant"))
            ok = typed.startswith("DECIMAL") if kind == "number" else F.lit(False)
            found.append(F.when(F.array_contains(keys, k) & ~(typed.isin(_TYPES[kind]) | ok), F.lit(f"{k} is not {kind}")))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, schema["properties"]))), lambda k: F.concat(F.lit("unexpected "), k))
        problems = F.when(arguments.isNull() | ~F.schema_of_variant(arguments).startswith("OBJECT"), F.array(F.lit("arguments are not an object"))).otherwise(F.concat(F.array_compact(F.array(*found)), extra))
        out = F.when(name == tool, problems).otherwise(out)
    return F.array_sort(out)


def _blocks(messages: DataFrame, pattern: str, kind: str) -> DataFrame:
    """(conv_id, turn, at, body, copies, v, id, kind): equal blocks at the same place of equal turns are counted, on the map side first."""
    found = messages.where(F.col("text").rlike(pattern)).select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("at", "body"))
    found = found.groupBy("conv_id", "turn", "at", "body").agg(F.count("*").alias("copies"))
    return found.withColumn("v", F.try_parse_json("body")).withColumn("id", _field(F.col("v"), "id")).withColumn("kind", F.lit(kind))


def _each(rows: DataFrame, status: Column) -> DataFrame:
    """Counted rows, one by one: the first has the status, further copies of a good one are duplicates."""
    each = rows.withColumn("status", status).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.withColumn("status", F.when((F.col("copy") > 1) & (F.col("status") != "malformed"), "duplicate").otherwise(F.col("status")))


def _firsts(blocks: DataFrame) -> DataFrame:
    """The block that counts for each identifier: a min over structs, so that a hot one is pre-aggregated."""
    good = blocks.where("id is not null and conv_id is not null and turn is not null")
    return good.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "at", "body")).alias("f")).select("conv_id", "id", "f.*")


def _unfold(state: DataFrame, edges: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """One round towards s = greatest(s, s of each need, its depth raised by k): (state, edges) after it.

    What is settled (no open edge) is folded into those that need it; an edge to a node with a single
    edge skips that node, so that chains halve (pointer jumping); the solution stays the same."""
    key = ["conv_id", "id"]
    info = state.join(edges.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("needs", "k")).alias("one")), key, "left")
    far = edges.join(info.select("conv_id", F.col("id").alias("needs"), F.col("s").alias("far"), "n", "one"), ["conv_id", "needs"])
    far = cut(far, "after")
    # the bound only stops the sums of cycles, which are discarded: no depth is above the number of calls
    up = far.groupBy(key).agg(F.max(F.struct(F.col("far.turn").alias("turn"), (F.col("far.depth") + F.col("k")).alias("depth"))).alias("up"))
    new = state.join(up, key, "left").select(*key, F.greatest("s", "up").alias("s"))
    single = F.col("n") == 1
    left = far.where("n is not null").select(*key, F.when(single, F.col("one.needs")).otherwise(F.col("needs")).alias("needs"), F.when(single, F.least(F.col("k") + F.col("one.k"), F.lit(1 << 40))).otherwise(F.col("k")).alias("k"))
    left = left.groupBy(*key, "needs").agg(F.max("k").alias("k"))
    out = cut(new, "depths"), cut(left.where("id <> needs") if step == 0 else left, "after")
    drop(far)
    return out


def _settle(state: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, open): s is right for all calls but the open ones, which are in cycles or after one."""
    left, before = edges.withColumn("k", F.lit(1).cast("long")), None
    while True:
        waiting = left.select("conv_id", "id").distinct()
        # a round settles at least one call that no cycle is before
        if (now := waiting.count()) in (0, before):
            return state, waiting
        before = now
        state, left = _unfold(state, left, 1)


def _greatest(nodes: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """(conv_id, id, s): s is the greatest label (a hash, then the id) of what a node reaches."""
    label = F.struct(F.xxhash64(F.lit(seed), "conv_id", "id").alias("hash"), "id")
    state = nodes.select("conv_id", "id", F.struct(label.alias("turn"), F.lit(0).cast("long").alias("depth")).alias("s"))
    left = edges.where("id <> needs").withColumn("k", F.lit(0).cast("long"))
    state, sum_before = cut(state, "depths"), None
    while True:
        state, left = _unfold(state, left, 0)
        now = state.agg(F.sum(F.xxhash64("conv_id", "id", "s").cast("decimal(38,0)"))).first()
        if now == sum_before:
            return state
        sum_before = now


def _in_cycles(edges: DataFrame) -> DataFrame:
    """The edges that lie on cycles (within strongly connected components).

    Ends of an edge that reach, or are reached by, different greatest labels are in different
    components: such edges go, under other labels each time, until both directions leave all."""
    turned = lambda e: e.select("conv_id", F.col("needs").alias("id"), F.col("id").alias("needs"))
    count, seed = edges.count(), 0
    while count:
        for way in (lambda e: e, turned):
            e = way(edges)
            nodes = e.select("conv_id", "id").union(turned(e).select("conv_id", "id")).distinct()
            seen = _greatest(nodes, e, seed)
            own, other = seen.select("conv_id", "id", F.col("s").alias("a")), seen.select("conv_id", F.col("id").alias("needs"), F.col("s").alias("b"))
            edges = cut(way(e.join(own, ["conv_id", "id"]).join(other, ["conv_id", "needs"]).where("a = b").select("conv_id", "id", "needs")), "after")
        if (now := edges.count()) == count:
            break
        count, seed = now, seed + 1
    return edges


SMALL = 62  # constrained calls of a conversation that are ordered within its row: a bit of a long for each


def _ordered(nodes: Column, edges: Column) -> Column:
    """(id, turn, depth, cyclic) of a small conversation's calls, from arrays of (id, turn) and (id, needs).

    Needs are bit masks; their closure (Warshall) finds cycles, and as many rounds as there are calls the longest paths."""
    power = F.array(*[F.lit(1 << i).cast("long") for i in range(SMALL)])
    every = F.sequence(F.lit(0), F.size(nodes) - 1)
    has = lambda mask, i: mask.bitwiseAND(F.get(power, i)) != 0
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    ids = F.transform(nodes, lambda x: x["id"])
    masks = F.transform(ids, lambda i: F.aggregate(F.filter(edges, lambda e: e["id"] == i), F.lit(0).cast("long"), lambda m, e: m.bitwiseOR(F.get(power, F.array_position(ids, e["needs"]).cast("int") - 1))))
    first = F.transform(nodes, lambda x: F.struct(x["turn"].alias("turn"), F.lit(0).cast("long").alias("depth")))

    def paths(adj: Column, closed: Column) -> Column:
        free = F.transform(adj, lambda m, i: F.when(has(F.get(closed, i), i), F.lit(0).cast("long")).otherwise(m))  # members of cycles keep their turns
        step = lambda s: F.transform(free, lambda m, i: F.greatest(F.get(first, i), F.array_max(F.transform(F.filter(every, lambda j: has(m, j)), lambda j: F.struct(F.get(s, j)["turn"].alias("turn"), (F.get(s, j)["depth"] + 1).alias("depth"))))))
        return let(F.aggregate(every, first, lambda s, _: step(s)), lambda s: F.transform(nodes, lambda x, i: F.struct(x["id"].alias("id"), F.get(s, i)["turn"].alias("turn"), F.get(s, i)["depth"].alias("depth"), has(F.get(closed, i), i).alias("cyclic"))))

    closure = lambda adj: F.aggregate(every, adj, lambda c, k: F.transform(c, lambda m: F.when(has(m, k), m.bitwiseOR(F.get(c, k))).otherwise(m)))
    return let(masks, lambda adj: let(closure(adj), lambda closed: paths(adj, closed)))


def _depths(calls: DataFrame) -> DataFrame:
    """(conv_id, id, turn, depth, cyclic) of calls: after every call that they name.

    Conversations of up to ``SMALL`` constrained calls are ordered in their rows, others by joins, whatever their size."""
    v = F.try_parse_json("body")
    after = F.from_json(F.to_json(F.try_variant_get(v, "$.after", "variant")), "array<string>")
    named = calls.select("conv_id", "id", F.explode(F.array_distinct(after)).alias("needs"))
    known = calls.select("conv_id", F.col("id").alias("needs"))
    edges = cut(named.join(known, ["conv_id", "needs"]).distinct().select("conv_id", "id", "needs"), "after")
    shown = lambda x, cyclic: x.select("conv_id", "id", "turn", F.lit(0).cast("long").alias("depth"), cyclic.alias("cyclic"))
    if edges.isEmpty():
        return shown(calls, F.lit(False))
    own = edges.select("conv_id", "id").union(edges.select("conv_id", F.col("needs").alias("id"))).distinct()
    few = cut(calls.select("conv_id", "id", "turn").join(own, ["conv_id", "id"], "left_semi"), "depths")
    sizes = few.groupBy("conv_id").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") <= SMALL).select("conv_id")
    rows = few.join(small, "conv_id", "left_semi").groupBy("conv_id").agg(F.collect_list(F.struct("id", "turn")).alias("nodes"))
    rows = rows.join(edges.join(small, "conv_id", "left_semi").groupBy("conv_id").agg(F.collect_list(F.struct("id", "needs")).alias("edges")), "conv_id")
    done = cut(rows.select("conv_id", F.inline(_ordered(F.col("nodes"), F.col("edges")))), "depths")
    rest = shown(calls.join(own, ["conv_id", "id"], "left_anti"), F.lit(False)).union(done)
    large = cut(sizes.where(F.col("n") > SMALL).select("conv_id"), "large")
    if large.isEmpty():
        return rest
    many = cut(edges.join(large, "conv_id", "left_semi"), "after")
    return rest.union(_joined_depths(few.join(large, "conv_id", "left_semi"), many))


def _joined_depths(calls: DataFrame, edges: DataFrame) -> DataFrame:
    state = cut(calls.select("conv_id", "id", F.struct("turn", F.lit(0).cast("long").alias("depth")).alias("s")), "depths")
    shown = lambda x, cyclic: x.select("conv_id", "id", "s.turn", "s.depth", cyclic.alias("cyclic"))
    done, waiting = _settle(state, edges)
    if waiting.isEmpty():
        return shown(done, F.lit(False))
    waiting = cut(waiting, "depths")
    among = edges.join(waiting, ["conv_id", "id"], "left_semi").join(waiting.select("conv_id", F.col("id").alias("needs")), ["conv_id", "needs"], "left_semi")
    cycles = cut(_in_cycles(cut(among.select("conv_id", "id", "needs"), "after")).select("conv_id", "id").distinct(), "depths")
    # members of cycles keep their turns; what comes after a cycle is ordered after its members
    done, _ = _settle(state, edges.join(cycles, ["conv_id", "id"], "left_anti"))
    return shown(done.join(cycles.withColumn("in", F.lit(True)), ["conv_id", "id"], "left"), F.col("in").isNotNull())


def format_chats(df: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, turn, depth, part, kind, status, problems, line): a row for each message and each tool block.

    Sorting by (conv_id, turn, depth, part, line) gives each conversation in topological order."""
    m = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", CALL, ""), RESULT, ""))
    shown = F.when(F.col("text").contains("<tool_"), plain).otherwise(F.col("text"))
    none = F.array().cast("array<string>")
    talk = m.select("conv_id", "turn", F.lit(0).alias("depth"), F.lit(0).alias("part"), F.lit("message").alias("kind"), F.lit("ok").alias("status"), none.alias("problems"), F.to_json(F.struct(shown.alias("content"), "role"), {"ignoreNullFields": "false"}).alias("line"))
    raw_calls, raw_results = _blocks(m, CALL, "call"), _blocks(m, RESULT, "result")
    calls, results = _firsts(raw_calls), _firsts(raw_results)
    depths = _depths(calls)
    v = F.col("v")
    arguments = F.try_variant_get(v, "$.arguments", "variant")
    mine = lambda side: side.select("conv_id", "id", F.col("turn").alias("ft"), F.col("at").alias("fa"), F.col("body").alias("fb"))
    answered = results.select("conv_id", "id", F.lit(True).alias("linked"))
    first = (F.col("turn") == F.col("ft")) & (F.col("at") == F.col("fa")) & (F.col("body") == F.col("fb"))
    state = F.when(F.col("id").isNull() | v.isNull(), "malformed").when(~F.coalesce(first, F.lit(False)), "duplicate").when(F.col("linked").isNull(), "orphan")
    c = raw_calls.join(mine(calls), ["conv_id", "id"], "left").join(answered, ["conv_id", "id"], "left").join(depths.select("conv_id", "id", F.col("turn").alias("to"), "depth", "cyclic"), ["conv_id", "id"], "left")
    malformed = F.to_json(F.struct(F.col("body").alias("malformed")))
    # a call's own depth d has part 1 and its result part 2, so nothing comes between that depends on neither
    call_line = F.to_json(F.struct(arguments.alias("arguments"), F.col("id"), _field(v, "name").alias("name")))
    cyclic = F.when(F.col("cyclic") & F.coalesce(first, F.lit(False)), "cyclic")
    call_rows = _each(c, F.coalesce(cyclic, state, F.lit("linked"))).select("conv_id", F.coalesce("to", "turn").alias("turn"), F.coalesce(F.col("depth"), F.lit(0)).alias("depth"), F.lit(1).alias("part"), "kind", "status", F.when(v.isNull(), F.array(F.lit("not JSON"))).otherwise(validate(_field(v, "name"), arguments, tools)).alias("problems"), F.when(v.isNull(), malformed).otherwise(call_line).alias("line"))
    called = calls.select("conv_id", "id", F.lit(True).alias("linked"))
    r = raw_results.join(mine(results), ["conv_id", "id"], "left").join(called, ["conv_id", "id"], "left").join(depths.select("conv_id", "id", F.col("turn").alias("to"), F.col("depth").alias("cd")), ["conv_id", "id"], "left")
    late = F.coalesce(F.col("to") >= F.col("turn"), F.lit(False))
    result_line = F.to_json(F.struct(F.try_variant_get(v, "$.content", "variant").alias("content"), F.col("id")))
    result_rows = _each(r, F.coalesce(state, F.lit("linked"))).select("conv_id", F.when(late, F.col("to")).otherwise(F.col("turn")).alias("turn"), F.when(late, F.col("cd")).otherwise(0).alias("depth"), F.lit(2).alias("part"), "kind", "status", F.when(v.isNull(), F.array(F.lit("not JSON"))).otherwise(none).alias("problems"), F.when(v.isNull(), malformed).otherwise(result_line).alias("line"))
    return talk.union(call_rows).union(result_rows)


_C, _T = "cast(conv_id as varchar(20))", "cast(turn as varchar(20))"
_AFTER = f"""case when conv_id % 5 = 1 and turn in (1, 3) then concat('["c', case when turn = 1 then '3' else '1' end, '"]')
  when (conv_id + turn) % 3 = 0 then concat('["c', cast(turn + 2 as varchar(20)), '","c', cast(turn - 2 as varchar(20)), '"]')
  when (conv_id + turn) % 3 = 1 then concat('["c', cast(turn + 4 as varchar(20)), '"]') else '[]' end"""
_ARGUMENTS = f"""case (conv_id + 2 * turn) % 7 when 0 then concat('{{"query":"q', {_C}, '","limit":', {_T}, '}}') when 1 then '{{"limit":"ten","query":"x"}}' when 2 then '{{}}'
  when 3 then concat('{{ "url" : "u/', {_T}, '", "timeout": 1.5}}') when 4 then '{{"timeout":2,"url":"v","zone":1}}' when 5 then '{{"expression":"1+1"}}' else '[1]' end"""
_NAME = "case (conv_id + turn) % 4 when 0 then 'search' when 1 then 'fetch' when 2 then 'calculate' else 'unheard' end"
#: Messages with tool blocks, in SQL that Spark and DuckDB both take: every message as it is, and blocks
#: that follow from its ids. Odd turns have calls (some twice, some in cycles, some that wait for later
#: ones), even turns have results (some before their calls, some without any, some of no identifier).
TOOL_TEXT = f"""concat(coalesce(text, ''),
  case when turn % 2 = 1 then concat(' <tool_call>{{"name":"', {_NAME}, '","id":"c', {_T}, '","after":', {_AFTER}, ',"arguments":', {_ARGUMENTS}, '}}</tool_call>') else '' end,
  case when turn % 2 = 1 and (conv_id + turn) % 4 = 1 then concat('<tool_call>{{"id":"c', {_T}, '","name":"search","arguments":{{"query":"again"}}}}</tool_call>') else '' end,
  case when turn % 2 = 0 and conv_id % 6 < 4 then concat('<tool_result>{{"id":"c', cast(turn + case when conv_id % 6 = 3 then 1 else -1 end as varchar(20)), '","content":"r', {_C}, '"}}</tool_result>') else '' end,
  case when turn % 2 = 0 and conv_id % 9 = 0 then '<tool_result>{{"content":7}}</tool_result>' else '' end)"""


def with_tools(conversations: DataFrame) -> DataFrame:
    """All messages, with the blocks of ``TOOL_TEXT``."""
    return conversations.withColumn("text", F.expr(TOOL_TEXT.replace("varchar(20)", "string")))


_OBJECT = """'{' || array_to_string([to_json(k)::varchar || ':' || json_extract(args, '$."' || k || '"')::varchar for k in list_sort(keys)], ',') || '}'"""
_CALL, _RESULT = "<tool_call>(.*?)</tool_call>", "<tool_result>(.*?)</tool_result>"
_PROBLEMS = """case name when 'search' then {search} when 'calculate' then {calculate} when 'fetch' then {fetch} else ['unknown tool ' || name] end""".format(
    **{
        tool: "list_filter(["
        + ", ".join([f"case when not list_contains(keys, '{k}') then 'missing {k}' end" for k in schema["required"]] + [f"case when list_contains(keys, '{k}') and json_type(args, '$.{k}') not in ({dict(string="'VARCHAR'", integer="'BIGINT', 'UBIGINT'", number="'BIGINT', 'UBIGINT', 'DOUBLE'")[kind]}) then '{k} is not {kind}' end" for k, kind in schema["properties"].items()])
        + "] || [case when k not in ("
        + ", ".join(f"'{k}'" for k in schema["properties"])
        + ") then 'unexpected ' || k end for k in keys], lambda x: x is not null)"
        for tool, schema in TOOLS.items()
    }
)
#: Linking, order (longest paths by recursion), cycles (closure), validation and canonical lines, on the same messages.
ORACLE = rf"""
with recursive m as (
  select conv_id, turn, role, {TOOL_TEXT} as text from conversations
), raw as (
  select conv_id, turn, kind, u.i - 1 as place, found[u.i] as body from (
    select conv_id, turn, 'call' as kind, regexp_extract_all(text, '{_CALL}', 1, 's') as found from m
    union all select conv_id, turn, 'result', regexp_extract_all(text, '{_RESULT}', 1, 's') from m) x, unnest(range(1, len(found) + 1)) as u(i)
), b as (
  select *, body->>'$.id' as id, row_number() over (partition by conv_id, kind, body->>'$.id' order by turn, place, body) as nth from raw
), calls as (select * from b where kind = 'call' and id is not null and nth = 1),
results as (select * from b where kind = 'result' and id is not null and nth = 1),
edges as (
  select distinct c.conv_id, c.id, n.id as needs from (select conv_id, id, unnest((body->'$.after')::varchar[]) as needs from calls) c
  join calls n on n.conv_id = c.conv_id and n.id = c.needs
), closure(conv_id, id, needs) as (
  select conv_id, id, needs from edges union select c.conv_id, c.id, e.needs from closure c join edges e on e.conv_id = c.conv_id and e.id = c.needs
), cycles as (select distinct conv_id, id from closure where id = needs),
paths(conv_id, id, turn, depth) as (
  select conv_id, id, turn, 0 from calls
  union select e.conv_id, e.id, p.turn, p.depth + 1 from paths p join edges e on e.conv_id = p.conv_id and e.needs = p.id
  where not exists (select 1 from cycles y where y.conv_id = e.conv_id and y.id = e.id)
), depths as (
  select conv_id, id, (max(struct_pack(turn := turn, depth := depth))).turn as turn, (max(struct_pack(turn := turn, depth := depth))).depth as depth from paths group by conv_id, id
), c as (
  select b.*, b.body->>'$.name' as name, json_extract(b.body, '$.arguments') as args, coalesce(json_keys(json_extract(b.body, '$.arguments')), []) as keys from b where kind = 'call'
), call_rows as (
  select c.conv_id, coalesce(d.turn, c.turn) as turn, coalesce(d.depth, 0) as depth, 1 as part, 'call' as kind,
    case when c.id is null then 'malformed' when c.nth > 1 then 'duplicate' when y.id is not null then 'cyclic' when r.id is null then 'orphan' else 'linked' end as status,
    array_to_string(list_sort(case when name in ('search', 'calculate', 'fetch') and json_type(args) <> 'OBJECT' then ['arguments are not an object'] else {_PROBLEMS} end), '; ') as problems,
    '{{"arguments":' || case when json_type(args) = 'OBJECT' then {_OBJECT} else args::varchar end || ',"id":' || to_json(c.id)::varchar || ',"name":' || to_json(name)::varchar || '}}' as line
  from c left join depths d on d.conv_id = c.conv_id and d.id = c.id left join cycles y on y.conv_id = c.conv_id and y.id = c.id
  left join results r on r.conv_id = c.conv_id and r.id = c.id
), result_rows as (
  select b.conv_id, case when d.turn >= b.turn then d.turn else b.turn end as turn, case when d.turn >= b.turn then d.depth else 0 end as depth, 2 as part, 'result' as kind,
    case when b.id is null then 'malformed' when b.nth > 1 then 'duplicate' when k.id is null then 'orphan' else 'linked' end as status, '' as problems,
    '{{"content":' || json_extract(b.body, '$.content')::varchar || case when b.id is null then '' else ',"id":' || to_json(b.id)::varchar end || '}}' as line
  from b left join depths d on d.conv_id = b.conv_id and d.id = b.id left join calls k on k.conv_id = b.conv_id and k.id = b.id where b.kind = 'result'
)
select conv_id, turn, 0 as depth, 0 as part, 'message' as kind, 'ok' as status, '' as problems,
  '{{"content":' || to_json(case when contains(text, '<tool_') then trim(regexp_replace(regexp_replace(text, '{_CALL}', '', 'gs'), '{_RESULT}', '', 'gs')) else text end)::varchar || ',"role":' || coalesce(to_json(role)::varchar, 'null') || '}}' as line
from m union all select * from call_rows union all select * from result_rows
"""
