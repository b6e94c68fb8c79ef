"""Registered queries of the code graph, repository sets and the software projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import code as C
from ..operators import scoring as Sc
from ..sources import adapter
from ..sources import store
from ..sources.code_adapter import VIEWS
from . import sqltext as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def view(spark, d, name) -> DataFrame:
    return adapter.view(spark, d, name, VIEWS)


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = adapter.with_views(sql, *views, views=VIEWS)
        return f

    return register


def r6(c):
    return F.round(c, 6)


def score_sql(query: str, fields: list[str]) -> str:
    """SQL of ``score_query``."""
    import re

    tokens = list(dict.fromkeys(x for w in query.lower().split() for x in [w, *([] if "/" in w else [p for p in re.findall(r"[a-z0-9_]+", w) if len(p) >= 2])]))
    one = lambda t, f: f"case when lower(coalesce({f}, '')) = '{t}' then 4.0 when list_contains({S.terms(f, 1)}, '{t}') then 2.0 when contains(lower(coalesce({f}, '')), '{t}') then 0.5 else 0.0 end"
    return "(" + " + ".join("greatest(0.0, " + ", ".join(one(t, f) for f in fields) + ")" for t in tokens) + ")::double"


# --- predicates ----------------------------------------------------------------------------------------


@query("select file_id, path from code_files where (path = 'src/brand7' or starts_with(path, 'src/brand7/') or path = 'tests' or starts_with(path, 'tests/')) and (language_id in ('cpp', 'python') or (language_id = 'c' and ends_with(path, '.h')))", "code_files")
def path_prefix_filter(spark, d):
    f = view(spark, d, "code_files")
    return f.where(P.any_filter(F.col("path"), ["./src/brand7/", "tests"]) & P.language_allows(F.col("path"), F.col("language_id"), ["cpp", "python"])).select("file_id", "path")


_CONTENT = "concat('module ', file_id, case when cast(file_id as bigint) % 19 = 0 then ' // Code generated by a tool. DO NOT EDIT.' when cast(file_id as bigint) % 23 = 0 then ' /* @Generated */' else ' x = 1' end)"


@query(rf"select path, regexp_matches(lower(path), '(\.min\.js|\.pb\.go|_pb2\.py|\.g\.dart|\.generated\.[a-z]+|\.lock)$') or regexp_matches(lower(path), '^(dist|build)/') or regexp_matches(lower(path), '(^|/)(target|generated)/') or regexp_matches(lower(substr({_CONTENT}, 1, 8192)), '@generated|do not edit|auto-?generated') as generated from code_files", "code_files")
def generated_detect(spark, d):
    return view(spark, d, "code_files").select("path", P.is_generated(F.col("path"), F.expr(_CONTENT)).alias("generated"))


@query(r"""select path, case when regexp_matches(b, '^knowledge[-_]?map\.') then 'knowledge_map' when regexp_matches(p, '\.(md|rst|adoc)$') or regexp_matches(p, '(^|/)docs?/') then 'documentation'
  when b in ('cargo.toml', 'cargo.lock', 'package.json', 'package-lock.json', 'pnpm-lock.yaml', 'pyproject.toml', 'requirements.txt', 'go.mod', 'go.sum', 'pom.xml', 'build.gradle', 'conanfile.txt') then 'dependency_manifest'
  when b in ('makefile', 'cmakelists.txt', 'build.rs', 'setup.py', 'gradlew') or ends_with(p, '.cmake') then 'build_manifest' when regexp_matches(b, '^(dockerfile|docker-compose)') or regexp_matches(p, '\.(tf|service)$') or regexp_matches(p, '(^|/)(k8s|helm|deploy)/') then 'deployment'
  when regexp_matches(p, '(^|/)tests?/|_test\.[a-z]+$|\.test\.[a-z]+$|(^|/)test_[^/]*$') then 'test' when regexp_matches(p, '\.(tmpl|tpl|j2|hbs)$') then 'template' when regexp_matches(p, '\.(json|yaml|yml|toml|ini|properties|xml|env)$') then 'configuration' else 'source' end as role
  from (select path, lower(path) as p, regexp_extract(lower(path), '[^/]*$') as b from (select path from code_files union all select path from code_deps union all select unnest(['docs/a.txt', 'knowledge_map.md', 'deploy/x.yaml', 'Makefile', 'a/b.tmpl', 'c.ini', 'Dockerfile'])) u) x""", "code_files", "code_deps")
def file_roles(spark, d):
    more = spark.createDataFrame([(x,) for x in ("docs/a.txt", "knowledge_map.md", "deploy/x.yaml", "Makefile", "a/b.tmpl", "c.ini", "Dockerfile")], "path string")
    x = view(spark, d, "code_files").select("path").union(view(spark, d, "code_deps").select("path")).union(more)
    return x.select("path", P.file_role(F.col("path")).alias("role"))


@query(r"""select route_id, url, case when url = '/api/v1/items/7' then 6.0::double else 5.0::double end as score from code_routes where url = '/api/v1/items/7'
  or (len(string_split(trim(url, '/'), '/')) = 4 and len(list_filter(string_split(trim(url, '/'), '/'), lambda s: regexp_matches(s, '^(:.+|\{.+\}|<.+>)$'))) >= 1
  and list_bool_and([regexp_matches(z[1], '^(:.+|\{.+\}|<.+>)$') or z[1] = z[2] for z in list_zip(string_split(trim(url, '/'), '/'), ['api', 'v1', 'items', '7'])]))""", "code_routes")
def route_match(spark, d):
    """Exact urls 6, parameterised ones 5; others are dropped as the query holds a url."""
    r = view(spark, d, "code_routes")
    exact = F.col("url") == "/api/v1/items/7"
    return r.where(exact | P.url_matches(F.col("url"), F.lit("/api/v1/items/7"))).select("route_id", "url", F.when(exact, 6.0).otherwise(5.0).alias("score"))


@query("select language_id, count(*)::bigint as files, sum(byte_len)::bigint as bytes, max_by(path, struct_pack(a := byte_len, b := path)) as largest from code_files group by 1", "code_files")
def scope_preview(spark, d):
    return view(spark, d, "code_files").groupBy("language_id").agg(F.count("*").alias("files"), F.sum("byte_len").alias("bytes"), F.max_by("path", F.struct("byte_len", "path")).alias("largest"))


# --- resolution ----------------------------------------------------------------------------------------

_RESOLVE = """with n as (select scope, name, count(*) as cn, min(symbol_id) as tn from code_symbols where {where} group by all), p as (select scope, name, path, min(symbol_id) as tp from code_symbols where {where} group by all having count(*) = 1),
  x as (select ref_id, case when cn = 1 then tn else tp end as target, cn from code_refs left join n using (scope, name) left join p using (scope, name, path) where {refs})
  select ref_id, target, case when target is not null then 'resolved' when cn is not null then 'ambiguous' else 'unresolved' end as state, case when target is not null then 8000 when cn is not null then 5000 else 2500 end as confidence from x"""


@query(_RESOLVE.format(where="true", refs="true"), "code_refs", "code_symbols")
def reference_resolution(spark, d):
    return C.resolve_references(view(spark, d, "code_refs"), view(spark, d, "code_symbols"))


@query(_RESOLVE.format(where="kind in ('function', 'method')", refs="kind = 'call'"), "code_refs", "code_symbols")
def call_target_resolution(spark, d):
    return C.resolve_calls(view(spark, d, "code_refs"), view(spark, d, "code_symbols"))


@query("select ref_id, arg_max(symbol_id, struct_pack(a := line_start, b := -line_end, c := s.name)) as symbol_id, arg_max(s.name, struct_pack(a := line_start, b := -line_end, c := s.name)) as symbol from code_refs r join code_symbols s on s.file_id = r.file_id and r.line between s.line_start and s.line_end group by 1", "code_refs", "code_symbols")
def enclosing_caller(spark, d):
    return C.enclosing(view(spark, d, "code_refs").select("ref_id", "file_id", "line"), view(spark, d, "code_symbols"), "ref_id")


@query("select ref_id, min_by(chunk_id, struct_pack(a := line_end - line_start, b := chunk_id)) as chunk_id from code_refs r join code_chunks c on c.file_id = r.file_id and r.line between line_start and line_end group by 1", "code_refs", "code_chunks")
def innermost_chunk(spark, d):
    return C.innermost_chunks(view(spark, d, "code_refs").select("ref_id", "file_id", "line"), view(spark, d, "code_chunks"), "ref_id")


@query("select symbol_id, (select max(p.line_end) from code_symbols p where p.file_id = s.file_id and p.line_end < s.line_start)::bigint as previous_end from code_symbols s", "code_symbols")
def predecessor_symbol(spark, d):
    """As-of lookup: the last end before each start, in its file. Symbols don't overlap, so it is the one before."""
    s = view(spark, d, "code_symbols")
    lines = s.select("file_id", F.col("line_end").alias("at"), F.lit(None).cast("string").alias("symbol_id"), F.col("line_end").alias("end")).union(s.select("file_id", F.col("line_start").alias("at"), "symbol_id", F.lit(None).cast("long")))
    before = Window.partitionBy("file_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("previous_end", F.max("end").over(before)).where("symbol_id is not null").select("symbol_id", "previous_end")


@query("select symbol_id, concat_ws('.', regexp_replace(regexp_replace(path, '\\.[A-Za-z0-9]+$', ''), '/', '.', 'g'), name) as qualified_name from code_symbols", "code_symbols")
def symbol_identity(spark, d):
    s = view(spark, d, "code_symbols")
    return s.select("symbol_id", F.concat_ws(".", F.regexp_replace(F.regexp_replace("path", r"\.[A-Za-z0-9]+$", ""), "/", "."), "name").alias("qualified_name"))


@query("select scope, callee, caller_id, count(*)::bigint as sites, (least(count(*) - 1, 3) * 0.25)::double as bonus from code_calls group by all having count(*) > 1", "code_calls")
def call_site_counts(spark, d):
    x = view(spark, d, "code_calls").groupBy("scope", "callee", "caller_id").agg(F.count("*").alias("sites")).where("sites > 1")
    return x.withColumn("bonus", F.least(F.col("sites") - 1, F.lit(3)) * F.lit(0.25))


# --- searches ------------------------------------------------------------------------------------------


def _role(words) -> str:
    return f"regexp_matches(lower(path), '{Sc.role_pattern(words)}')"


_TESTED = f"case when {_role(Sc.TEST)} then -0.75 else 0 end"

SYMBOL_QUERY = "kind:function,method lang:rust,python fn_7"


@query(f"""with b as (select symbol_id, path, line_start as line, is_generated, kind, {score_sql('fn_7', ['name', 'path', 'kind'])} as base from code_symbols where language_id in ('rust', 'python') and kind in ('function', 'method')),
  s as (select symbol_id, path, line, case when is_generated then 0.35 else 1 end * (base + case when lower(path) = 'fn_7' then 4 when regexp_extract(lower(path), '[^/]*$') = 'fn_7' then 2 else 0 end + 0.25 + {_TESTED}) as score from b where base > 0)
  select symbol_id, path, line, round(score, 6)::double as score from s order by round(s.score, 9) desc, path, line, symbol_id limit 200""", "code_symbols")
def symbol_search(spark, d):
    return C.search_symbols(view(spark, d, "code_symbols"), C.parse_query(SYMBOL_QUERY), 200).withColumn("score", r6("score"))


@query(f"select ref_id, path, line, round(score, 6)::double as score from (select *, b + 1.5 + case when {_role(Sc.TEST)} then -1.25 else 0.2 end as score from (select *, {score_sql('fn_131 brand7', ['name', 'path'])} as b from code_refs) y where b > 0) x order by round(x.score, 9) desc, path, line, ref_id limit 200", "code_refs")
def reference_search(spark, d):
    return C.search_references(view(spark, d, "code_refs"), "fn_131 brand7", C.layer_limit("reference", 2)).withColumn("score", r6("score"))


_PLAIN = f"not {_role(Sc.TEST)} and not {_role(Sc.EXAMPLE)}"
_NOT_ADAPTER = f" and not {_role(Sc.ADAPTER)} and not regexp_matches(lower(path), '(^|/)c(\\.[^.]*)?$')"
_CALLS = "n as (select caller_id, callee, count(*) as n from code_calls where {where} group by all), s as (select call_id, caller, path, line, 4.0 + least(n - 1, 3) * 0.25 + case when {plain} then 0.2 else 0 end + {tested} + case when {example} then -0.6 else 0 end as score from code_calls join n using (caller_id, callee) where {where}) select call_id, caller, path, line, round(score, 6)::double as score from s order by round(s.score, 9) desc, path, line, call_id limit {limit}"


@query("with " + _CALLS.format(where="lower(callee) = 'fn_131'", limit=500, plain=_PLAIN + _NOT_ADAPTER, tested=_TESTED, example=_role(Sc.EXAMPLE)), "code_calls")
def callers(spark, d):
    return C.search_calls(view(spark, d, "code_calls"), "callee", "fn_131", C.layer_limit("caller", 5)).withColumn("score", r6("score"))


@query("with " + _CALLS.format(where="lower(caller) = 'fn_262'", limit=250, plain=_PLAIN, tested=_TESTED, example=_role(Sc.EXAMPLE)), "code_calls")
def callee_search(spark, d):
    return C.search_calls(view(spark, d, "code_calls"), "caller", " FN_262", C.layer_limit("call", 5)).withColumn("score", r6("score"))


@query("select callee, count(*)::bigint as calls, min(line)::bigint as first_line, (row_number() over (order by min(line), callee))::int as execution_order from code_calls where caller = 'fn_262' group by callee", "code_calls")
def callees(spark, d):
    """What a caller calls, in the order of the first call sites."""
    x = view(spark, d, "code_calls").where("caller = 'fn_262'").groupBy("callee").agg(F.count("*").alias("calls"), F.min("line").alias("first_line"))
    return x.withColumn("execution_order", F.row_number().over(Window.orderBy("first_line", "callee")))  # one caller's callees


@query(f"select import_id, path, line, module, round(score, 6)::double as score from (select *, b + case when {_role(Sc.TEST)} then -1.25 else 0 end as score from (select *, {score_sql('mod_49 brand9', ['module', 'path'])} as b from code_imports) y where b > 0) x order by round(x.score, 9) desc, path, line, import_id limit 350", "code_imports")
def imports(spark, d):
    return C.search_imports(view(spark, d, "code_imports"), "mod_49 brand9", C.layer_limit("import", 10)).withColumn("score", r6("score"))


@query(f"select import_id, round(score, 6)::double as score from (select *, b + case when {_role(Sc.TEST)} then -1.25 else 0 end + 5.25 / line + case when regexp_replace(lower(regexp_extract(path, '[^/]*$')), '\\.[^.]*$', '') = 'local' and regexp_matches(path, '\\.(c|cc|cpp|cxx|m|mm)$') then -0.8 else 0 end as score from (select *, {score_sql('./local', ['module', 'path'])} as b from code_imports) y where b > 0) x order by round(x.score, 9) desc, path, line, import_id limit 350", "code_imports")
def import_path_search(spark, d):
    """A relative path is asked for: early lines count more."""
    return C.search_imports(view(spark, d, "code_imports"), "./local", C.layer_limit("import", 10)).select("import_id", r6("score").alias("score"))


@query(f"""select dep_id, package_name, case when is_lockfile then 'locked' else 'declared' end as state, round(score, 6) as score from (select *, {score_sql('pkg-building-7', ['package_name', 'ecosystem', 'path', 'requirement'])} + case when package_name = 'pkg-building-7' then 8 else 0 end + case when is_lockfile then 0.25 else 0 end as score from code_deps) x
  where x.score > 0.25 order by (package_name = 'pkg-building-7') desc, round(x.score, 9) desc, is_lockfile desc, path, line, dep_id limit 350""", "code_deps")
def sbom(spark, d):
    q = "pkg-building-7"
    base = T.score_query(q, [F.col(c) for c in ("package_name", "ecosystem", "path", "requirement")])
    exact = F.col("package_name") == q
    x = view(spark, d, "code_deps").withColumn("score", base + F.when(exact, 8.0).otherwise(0.0) + F.when(F.col("is_lockfile"), 0.25).otherwise(0.0)).where("score > 0.25")
    x = x.orderBy(exact.desc(), F.desc(F.round("score", 9)), F.desc("is_lockfile"), "path", "line", "dep_id").limit(C.layer_limit("sbom", 10))
    return x.select("dep_id", "package_name", F.when(F.col("is_lockfile"), "locked").otherwise("declared").alias("state"), r6("score").alias("score"))


@query(f"with c as (select * from code_chunks where contains(content, 'method') and contains(content, 'fn_2')) select chunk_id, path, line_start as line, round(case when is_generated then 0.35 else 1 end * {score_sql('method fn_2', ['content', 'path'])}, 6)::double as score from c order by 4 desc, path, line, chunk_id limit 300", "code_chunks")
def chunk_search(spark, d):
    """All terms must occur; then the base score."""
    return C.search_chunks(view(spark, d, "code_chunks"), C.parse_query("method fn_2"), 300).withColumn("score", r6("score"))


NEAR_QUERY = "method returns retry policy brand7 generated"
_NQ = Sc.near_terms(NEAR_QUERY)
_LINE_TERMS = r"list_filter(flatten([list_concat([lower(t)], list_concat(string_split(lower(t), '_'), string_split(lower(regexp_replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z0-9_])([A-Z][a-z])', '\\1 \\2', 'g')), ' '))) for t in regexp_extract_all(ln, '[A-Za-z0-9_]+')]), lambda z: z <> '')".replace("\\\\", "\\")
_NEAR = " + ".join(f"(len(list_filter(w, lambda x: x = '{t}' or (length(x) >= 4 and {len(t)} >= 4 and (starts_with(x, '{t}') or starts_with('{t}', x))))) > 0)::int" for t in _NQ)


@query(f"""with c as (select chunk_id, path, string_split(replace(content, ' ', chr(10)), chr(10)) as ls from code_chunks), l as (select chunk_id, path, i, {_LINE_TERMS} as ts from (select chunk_id, path, i, ls[i] as ln from c, unnest(range(1, len(ls) + 1)) as u(i)) z where trim(ln) <> ''),
  g as (select a.chunk_id, a.path, a.i, flatten(list(b.ts)) as w from l a join l b on a.chunk_id = b.chunk_id and b.i between a.i and a.i + 5 group by all), n as (select chunk_id, path, max({_NEAR}) as n from g group by all)
  select chunk_id, round(case when n >= {max(5, -(-len(_NQ) * 3 // 4))} and not regexp_matches(path, '(^|/)tests(/|$)') then least(1.9, 0.45 + n / {len(_NQ)} * 1.45) else 0 end, 6)::double as bonus from n""", "code_chunks")
def chunk_proximity(spark, d):
    """Terms of a longer question within six lines of a chunk."""
    c = view(spark, d, "code_chunks").select("chunk_id", "path", F.replace("content", F.lit(" "), F.lit("\n")).alias("content"))
    return c.select("chunk_id", r6(Sc.proximity(F.lit(6.0), F.col("content"), F.col("path"), NEAR_QUERY)).alias("bonus"))


@query("select path, sum(4 * contains(lower(path), 'brand7')::int + contains(lower(content), 'retry')::int + contains(lower(content), 'fn_77')::int)::bigint as points from code_chunks group by path order by 2 desc, path limit 100", "code_chunks")
def candidate_paths(spark, d):
    p = lambda c, t, n: F.when(F.lower(c).contains(t), n).otherwise(0)
    x = view(spark, d, "code_chunks").groupBy("path").agg(F.sum(p(F.col("path"), "brand7", 4) + p(F.col("content"), "retry", 1) + p(F.col("content"), "fn_77", 1)).alias("points"))
    return x.orderBy(F.desc("points"), "path").limit(100)


_MK = r"list_distinct([replace(st, '/', '::'), replace(st, '/', '.'), replace(ba, '/', '::'), replace(ba, '/', '.'), 'crate::' || replace(ba, '/', '::')])"
_KEYS = rf"keys as (select scope, file_id, path, unnest({_MK}) as module from (select *, regexp_replace(st, '^src/', '') as ba from (select *, regexp_replace(path, '\.[A-Za-z0-9]+$', '') as st from code_files) a) b)"


@query(f"with {_KEYS} select path, array_to_string(list_sort(list(distinct module)), ' ') as keys from keys group by path", "code_files")
def module_keys(spark, d):
    return view(spark, d, "code_files").select("path", F.array_join(P.module_keys(F.col("path")), " ").alias("keys"))


_IMPACT = f"""with {_KEYS}, changed as (select path from code_files where file_id in ('3', '5', '26', '50', '91')),
  names as (select name from code_symbols where path in (select path from changed) union select 'fn_999'),
  x as (select path, line_start as line, 'changed' as kind, 4.0 as s from code_chunks where path in (select path from changed)
    union select path, line, 'caller', 2.5 from code_calls where callee in (select name from names) and path not in (select path from changed)
    union select path, line, 'importer', 2.0 from code_imports where module in (select module from keys where path in (select path from changed)))
  select x.path, x.line, x.kind, round(s * case when f.is_generated then 0.35 else 1 end + 3, 6)::double as score from x left join (select path, is_generated from code_files) f using (path)"""


@query(_IMPACT, "code_files", "code_symbols", "code_chunks", "code_calls", "code_imports")
def impact(spark, d):
    v = lambda n: view(spark, d, n)
    changed = v("code_files").where(F.col("file_id").isin("3", "5", "26", "50", "91")).select("path")
    deleted = spark.createDataFrame([("fn_999",)], "name string")
    return C.impact(changed, deleted, v("code_chunks"), v("code_calls"), v("code_symbols"), v("code_imports"), v("code_files")).withColumn("score", r6("score"))


@query("""select scope, name, max(case edge_kind when 'guards_code' then 20 when 'defines_config' then 16 else 12 end + confidence / 1000.0 + 8)::double as score, count(*)::bigint as usages, string_agg(usage_id, ' ' order by line, usage_id) as usage_ids from code_flags where contains(lower(name), 'click') group by all""", "code_flags")
def feature_flag_groups(spark, d):
    x = C.feature_flags(view(spark, d, "code_flags"), "click")
    return x.select("scope", "name", F.col("score").cast("double").alias("score"), F.size("usages").cast("long").alias("usages"), F.array_join(F.transform("usages", lambda z: z["usage_id"]), " ").alias("usage_ids"))


_SEEDS = f"""seeds as (select symbol_id, name, path from (select *, {score_sql('fn_262', ['name'])} as score from code_symbols) z where score > 0 order by score desc, path, line_start, symbol_id limit 3)"""


@query(f"""with {_SEEDS}, c as (select seeds.symbol_id as seed, 'caller' as expansion, call_id as hit, row_number() over (partition by seeds.symbol_id order by code_calls.path, line, call_id) as r from seeds join code_calls on callee = seeds.name
  union all select seeds.symbol_id, 'callee', call_id, row_number() over (partition by seeds.symbol_id order by line, call_id) from seeds join code_calls on caller_id = seeds.symbol_id)
  select seed, expansion, hit, r::int as rank from c where r <= 4""", "code_symbols", "code_calls")
def codegraph_context(spark, d):
    """Three seeds by score, each with up to four callers and callees."""
    s = T.score_query("fn_262", [F.col("name")])
    seeds = view(spark, d, "code_symbols").withColumn("score", s).where("score > 0").orderBy(F.desc("score"), "path", "line_start", "symbol_id").limit(3).select(F.col("symbol_id").alias("seed"), "name")
    calls = view(spark, d, "code_calls")
    w = lambda *o: F.row_number().over(Window.partitionBy("seed").orderBy(*o))
    seeds = F.broadcast(seeds)  # three rows
    a = calls.join(seeds, calls.callee == seeds.name).select("seed", F.lit("caller").alias("expansion"), F.col("call_id").alias("hit"), w("path", "line", "call_id").alias("rank"))
    b = calls.join(seeds, calls.caller_id == seeds.seed).select("seed", F.lit("callee"), "call_id", w("line", "call_id"))
    return a.union(b).where("rank <= 4")


@query("select path, line, excerpt, max(score)::double as score, array_to_string(list_sort(list(distinct layer)), ' ') as layers from (select path, line_start as line, name as excerpt, 'symbol' as layer, 1.0 as score from code_symbols union all select path, line, name, 'reference', 1.5 from code_refs) u group by all", "code_symbols", "code_refs")
def dedupe_best_hit(spark, d):
    a = view(spark, d, "code_symbols").select("path", F.col("line_start").alias("line"), F.col("name").alias("excerpt"), F.array(F.lit("symbol")).alias("layers"), F.lit(1.0).alias("score"))
    b = view(spark, d, "code_refs").select("path", "line", "name", F.array(F.lit("reference")), F.lit(1.5))
    return C.dedupe_best(a.union(b)).withColumn("layers", F.array_join("layers", " "))


@query("select path, chunk_id, r::int as r from (select path, chunk_id, row_number() over (partition by path order by line_start, chunk_id) as r from code_chunks) x where r <= 2", "code_chunks")
def row_number_chunks(spark, d):
    w = Window.partitionBy("path").orderBy("line_start", "chunk_id")
    return view(spark, d, "code_chunks").select("path", "chunk_id", F.row_number().over(w).alias("r")).where("r <= 2")


@query("select name, arg_min(id, prec) as id, min(prec)::int as precedence from (select symbol_id as id, symbol_id as name, 0 as prec from code_symbols where kind = 'class' union all select min(symbol_id), name, 1 from code_symbols group by name) u group by name", "code_symbols")
def union_precedence(spark, d):
    """A match by id goes before one by alias."""
    s = view(spark, d, "code_symbols")
    u = s.where("kind = 'class'").select(F.col("symbol_id").alias("id"), F.col("symbol_id").alias("name"), F.lit(0).alias("p")).union(s.groupBy("name").agg(F.min("symbol_id").alias("id")).select("id", "name", F.lit(1)))
    return u.groupBy("name").agg(F.min_by("id", "p").alias("id"), F.min("p").alias("precedence"))


# --- repository sets -----------------------------------------------------------------------------------

_CROSS = rf"""{_KEYS}, o as (select scope, import_id, module from code_imports where resolution = 'unresolved' and not regexp_matches(module, '^(\.|crate::|self::|super::)')),
  f as (select import_id, count(distinct file_id) as c, min(file_id) as to_file from o join keys using (module) where o.scope <> keys.scope group by 1),
  edges as (select o.scope, o.import_id, case when c = 1 then to_file end as to_file, case when c = 1 then 'resolved' when c > 1 then 'ambiguous' else 'unresolved' end as state, case when c = 1 then 10000 when c > 1 then 5000 else 0 end as confidence from o left join f using (import_id))"""


@query(f"with {_CROSS} select * from edges", "code_files", "code_imports")
def cross_repo_edges(spark, d):
    return C.cross_edges(view(spark, d, "code_imports"), view(spark, d, "code_files"))


@query(f"with {_CROSS} select scope, count(*) filter (state = 'resolved')::bigint as resolved, count(*) filter (state = 'ambiguous')::bigint as ambiguous, count(*) filter (state = 'unresolved')::bigint as unresolved from edges group by scope", "code_files", "code_imports")
def overlay_counts(spark, d):
    return cross_repo_edges(spark, d).groupBy("scope").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("resolved", "ambiguous", "unresolved")])


@query(f"""with {_CROSS}, h as (select i.scope, i.import_id as hit, path, line, {score_sql('mod_49', ['module'])} as base from code_imports i), m as (
  select alias, hit, path, line, h.scope, base + priority * 0.01 + coalesce(confidence, 0) / 10000.0 - case when stale then 0.5 else 0 end as score from h join repo_members using (scope) left join edges on edges.import_id = h.hit where base > 0)
  select alias, hit, path, line, round(score, 6)::double as score from (select *, row_number() over (partition by alias order by round(score, 9) desc, path, line, hit) as r from m) z where r <= 20""", "code_files", "code_imports", "repo_members")
def repo_set_ranking(spark, d):
    """Each member's best hits by score + priority + edge confidence - staleness."""
    w = Window.partitionBy("alias").orderBy(F.desc(F.round("score", 9)), "path", "line", "hit")
    return _ranked_set(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 20").select("alias", "hit", "path", "line", r6("score").alias("score"))


def _ranked_set(spark, d):
    i = view(spark, d, "code_imports").withColumn("base", T.score_query("mod_49", [F.col("module")])).where("base > 0")
    e = C.cross_edges(i, view(spark, d, "code_files")).select(F.col("import_id").alias("hit"), "confidence")  # only hits need their edges
    x = i.withColumnRenamed("import_id", "hit").join(view(spark, d, "repo_members"), "scope").join(e, "hit", "left")
    return x.withColumn("score", F.col("base") + F.col("priority") * 0.01 + F.coalesce("confidence", F.lit(0)) / 10000 - F.when(F.col("stale"), 0.5).otherwise(0.0))


@query("select f.scope, count(*)::bigint as files, count(*) filter (parse_status = 'degraded')::bigint as degraded, any_value(symbols)::bigint as symbols, any_value(generated)::bigint as generated_symbols, any_value(first3) as first_symbols from code_files f join (select scope, count(*) as symbols, count(*) filter (is_generated) as generated, array_to_string(list_sort(list(distinct symbol_id))[1:3], ' ') as first3 from code_symbols group by scope) s using (scope) group by f.scope", "code_files", "code_symbols")
def repo_report(spark, d):
    f = view(spark, d, "code_files").groupBy("scope").agg(F.count("*").alias("files"), F.count_if(F.col("parse_status") == "degraded").alias("degraded"))
    ids = view(spark, d, "code_symbols")
    # three first ids of each scope, without collecting a scope's symbols
    w = Window.partitionBy("scope").orderBy("symbol_id")
    first = ids.select("scope", "symbol_id").distinct().withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("scope").agg(F.array_join(F.array_sort(F.collect_list("symbol_id")), " ").alias("first_symbols"))
    s = ids.groupBy("scope").agg(F.count("*").alias("symbols"), F.count_if("is_generated").alias("generated_symbols"))
    return f.join(s, "scope").join(first, "scope")


@query("select scope, resolution, count(*)::bigint as n, count(distinct module)::bigint as modules from code_imports group by all", "code_imports")
def resolution_histogram(spark, d):
    return view(spark, d, "code_imports").groupBy("scope", "resolution").agg(F.count("*").alias("n"), F.count_distinct("module").alias("modules"))


# --- software projection -------------------------------------------------------------------------------


@query("select scope, ecosystem, package_name, case when bool_or(is_lockfile) then 'locked' else 'declared' end as state, min(path) as path, count(*)::bigint as declarations from code_deps group by scope, ecosystem, package_name", "code_deps")
def software_components(spark, d):
    x = view(spark, d, "code_deps").groupBy("scope", "ecosystem", "package_name")
    return x.agg(F.when(F.bool_or("is_lockfile"), "locked").otherwise("declared").alias("state"), F.min("path").alias("path"), F.count("*").alias("declarations"))


@query("select i.scope, i.module, f.language_id, count(*)::bigint as usages, count(distinct i.path)::bigint as files from code_imports i join code_files f using (file_id) where i.resolution <> 'resolved' and not regexp_matches(i.module, '^(\\.|crate::|self::|super::)') group by all", "code_imports", "code_files")
def sdk_usages(spark, d):
    f = view(spark, d, "code_files").select("file_id", F.col("language_id").alias("lang"))
    i = view(spark, d, "code_imports").where((F.col("resolution") != "resolved") & ~P.is_relative_module(F.col("module"))).join(f, "file_id")
    return i.groupBy("scope", "module", F.col("lang").alias("language_id")).agg(F.count("*").alias("usages"), F.count_distinct("path").alias("files"))


@query("""select 'depends_on' as relationship, path as src, package_name as dst, min(8000 + case when is_lockfile then 1000 else 0 end)::int as confidence from code_deps group by all
  union all select 'uses_sdk', path, module, 5000 from code_imports where resolution <> 'resolved' group by all
  union all select 'configures', file_id, name, min(confidence)::int from code_flags where edge_kind = 'defines_config' group by all""", "code_deps", "code_imports", "code_flags")
def software_relationships(spark, d):
    a = view(spark, d, "code_deps").groupBy("path", "package_name").agg(F.min(F.lit(8000) + F.when(F.col("is_lockfile"), 1000).otherwise(0)).alias("c")).select(F.lit("depends_on").alias("relationship"), F.col("path").alias("src"), F.col("package_name").alias("dst"), F.col("c").alias("confidence"))
    b = view(spark, d, "code_imports").where("resolution <> 'resolved'").select(F.lit("uses_sdk"), "path", "module", F.lit(5000)).distinct()
    c = view(spark, d, "code_flags").where("edge_kind = 'defines_config'").groupBy("file_id", "name").agg(F.min("confidence").cast("int").alias("c")).select(F.lit("configures"), "file_id", "name", "c")
    return a.union(b).union(c)


@query(f"with p as (select file_id, path, regexp_replace(lower(path), '[/._]', ' ', 'g') as words from code_files), q as (select * from p where contains(' ' || words || ' ', ' brand7 ') and contains(' ' || words || ' ', ' mod ')) select path, (row_number() over (order by round(score, 9) desc, path))::int as rank from q join ({S.bm25('p', 'file_id', 'words', 'brand7 mod')}) s using (file_id) order by round(score, 9) desc, path limit 50", "code_files")
def file_search(spark, d):
    """All terms must occur in the path's parts; BM25, then path."""
    from ..operators.retrieval import bm25

    p = view(spark, d, "code_files").select("file_id", "path", F.regexp_replace(F.lower("path"), "[/._]", " ").alias("words"))
    padded = F.concat(F.lit(" "), "words", F.lit(" "))
    hits = p.where(padded.contains(" brand7 ") & padded.contains(" mod ")).join(bm25(p, "brand7 mod", "file_id", "words"), "file_id")
    few = hits.orderBy(F.desc(F.round("score", 9)), "path").limit(50)
    return few.select("path", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "path")).alias("rank"))


_HEAD = "select case when cast(file_id as bigint) % 10 = 3 then concat('moved/', path) else path end as path, case when cast(file_id as bigint) % 7 = 0 then 'new' else concat(blob_hash, file_id) end as blob_hash from code_files where cast(file_id as bigint) % 4 <> 0"


@query(f"""with o as (select path, concat(blob_hash, file_id) as blob_hash from code_files where file_id::bigint % 5 <> 0), n as ({_HEAD}),
  x as (select coalesce(o.path, n.path) as path, o.blob_hash as old, n.blob_hash as new from o full join n using (path) where old is null or new is null or old <> new), g as (select old as new, min(path) as old_path from x where new is null group by 1)
  select path, case when old_path is not null then 'renamed' when old is null then 'added' when x.new is null then 'deleted' else 'modified' end as change, old_path from x left join g using (new)""", "code_files")
def snapshot_diff(spark, d):
    f = view(spark, d, "code_files")
    base = f.where("cast(file_id as bigint) % 5 <> 0").select("path", F.concat("blob_hash", "file_id").alias("blob_hash"))
    return store.diff(base, spark.sql(_HEAD.replace("code_files", "{f}"), f=f))


@query("select symbol_id, name, path from code_symbols where path not in (select path from code_files where file_id::bigint % 9 = 0) union all select symbol_id, concat(name, '_v2'), path from code_symbols where path in (select path from code_files where file_id::bigint % 9 = 0) and kind <> 'class'", "code_symbols", "code_files")
def incremental_overlay(spark, d):
    """Rows of unchanged paths stay, those of changed paths are replaced."""
    s = view(spark, d, "code_symbols")
    changed = view(spark, d, "code_files").where("cast(file_id as bigint) % 9 = 0").select("path")
    new = s.where("kind <> 'class'").join(changed, "path", "left_semi").select("symbol_id", F.concat("name", F.lit("_v2")).alias("name"), "path")
    return store.overlay(s.select("symbol_id", "name", "path"), changed, new)


@query("select path, name from (select path, name from code_symbols where kind <> 'class') b where (path, name) not in (select path, name from code_symbols where kind = 'method')", "code_symbols")
def deleted_symbols(spark, d):
    s = view(spark, d, "code_symbols")
    return s.where("kind <> 'class'").select("path", "name").join(s.where("kind = 'method'").select("path", "name").distinct(), ["path", "name"], "left_anti")


@query(f"""with {_KEYS}, f as (select import_id, count(distinct keys.file_id) as c, min(keys.file_id) as to_file from code_imports i join keys on i.scope = keys.scope and i.module = keys.module group by 1)
  select i.import_id, case when c = 1 then to_file end as to_file, case when c = 1 then 'resolved' when c > 1 then 'ambiguous' else 'unresolved' end as state, case when c = 1 then 10000 when c > 1 then 5000 else 0 end as confidence from code_imports i left join f using (import_id)""", "code_files", "code_imports")
def import_resolution(spark, d):
    return C.resolve_imports(view(spark, d, "code_imports"), view(spark, d, "code_files"))


@query(f"""with {_KEYS}, f as (select import_id, count(distinct keys.file_id) as c, min(keys.file_id) as to_file from code_imports i join keys on i.scope = keys.scope and i.module = keys.module group by 1),
  t as (select distinct i.file_id, f.to_file from code_imports i join f using (import_id) where c = 1), o as (select file_id as to_file, name, min(symbol_id) as target from code_symbols group by all having count(*) = 1)
  select ref_id, min(target) as target from code_refs r join t using (file_id) join o using (to_file, name) group by ref_id having count(distinct target) = 1""", "code_files", "code_imports", "code_symbols", "code_refs")
def imported_reference_resolution(spark, d):
    return C.resolve_through_imports(*[view(spark, d, f"code_{t}") for t in ("refs", "imports", "files", "symbols")])


@query("""with m as (select 'brand7' as package, 'w0' as member union all select 'brand7.mod_4', 'w1' union all select 'brand9', 'w2'), s as (select import_id, string_split(regexp_replace(module, '::|/', '.', 'g'), '.') as seg from code_imports),
  p as (select import_id, array_to_string(seg[1:i::int], '.') as package from s, unnest(range(1, len(seg) + 1)) as u(i)) select import_id, arg_max(member, length(package)) as member from p join m using (package) group by 1""", "code_imports")
def workspace_import_mapping(spark, d):
    m = spark.createDataFrame([("brand7", "w0"), ("brand7.mod_4", "w1"), ("brand9", "w2")], "package string, member string")
    return C.workspace_imports(view(spark, d, "code_imports"), F.broadcast(m))  # three rows


@query(f"""with {_CROSS}, h as (select import_id as hit, file_id from code_imports where contains(module, 'mod_49')), e as (select edges.import_id, i.file_id as from_file, confidence from edges join code_imports i using (import_id) where confidence > 0),
  u as (select hit, import_id, 0 as via, confidence from h join e on h.hit = e.import_id union all select hit, import_id, 1, confidence from h join e on h.file_id = e.from_file where import_id <> hit)
  select hit, import_id, via from (select *, row_number() over (partition by hit order by via, confidence desc, import_id) as r from u) z where r <= 3""", "code_files", "code_imports")
def overlay_evidence(spark, d):
    i = view(spark, d, "code_imports")
    hits = i.where(F.col("module").contains("mod_49")).select(F.col("import_id").alias("id"), "file_id")
    e = cross_repo_edges(spark, d).where("confidence > 0").join(i.select("import_id", F.col("file_id").alias("from_file")), "import_id").select("import_id", "from_file", "confidence")
    return C.overlay_evidence(hits, e)


@query("select repository, arg_max(scope, version) as scope from (select scope as repository, concat(scope, ':', c_custkey) as scope, c_custkey as version, c_custkey % 3 as k from (select concat('repo', c_nationkey) as scope, c_custkey from customer) a) s where k = 0 or k = 1 group by repository")
def scope_resolution(spark, d):
    """Requests for src/a: scopes of everything, or of src/a, cover it; those of src/b don't."""
    c = view(spark, d, "customer").select(F.concat(F.lit("repo"), "c_nationkey").alias("repository"), F.col("c_custkey").alias("version"))
    c = c.withColumn("scope", F.concat("repository", F.lit(":"), F.col("version").cast("string")))
    none = F.array().cast("array<string>")
    c = c.withColumn("path_filters", F.when(F.col("version") % 3 == 0, none).when(F.col("version") % 3 == 1, F.array(F.lit("src/a"))).otherwise(F.array(F.lit("src/b"))))
    return C.pick_scope(c, c.select("repository").distinct().withColumn("wanted", F.array(F.lit("src/a"))))


@query("select hit, (select count(*) from code_calls where callee = 'fn_131') > 20 as saturated from (select call_id as hit from code_calls where callee = 'fn_131' order by path, line, call_id limit 20) x", "code_calls")
def saturation_probe(spark, d):
    """One row more than asked for tells whether the limit cut anything."""
    rows = C.saturated(view(spark, d, "code_calls").where("callee = 'fn_131'"), ["path", "line", "call_id"], 20)
    return rows.select(F.col("call_id").alias("hit"), "saturated")


@query(f"""with {_CROSS}, h as (select i.scope, i.import_id as hit, path, line, {score_sql('mod_49', ['module'])} as base from code_imports i), m as (
  select alias, hit, path, line, base + priority * 0.01 + coalesce(confidence, 0) / 10000.0 - case when stale then 0.5 else 0 end as score from h join repo_members using (scope) left join edges on edges.import_id = h.hit where base > 0),
  r as (select *, row_number() over (partition by alias order by round(score, 9) desc, path, line, hit) as r, max(score) over (partition by alias) as best from m),
  k as (select *, r <= 3 and score >= greatest(best * 0.45, best - 10) as kept from r where r <= 20)
  select alias, hit, kept, round(score, 6)::double as score from k order by kept desc, round(k.score, 9) desc, alias, path, line, hit limit 25""", "code_files", "code_imports", "repo_members")
def set_diversification(spark, d):
    """At most three of each member first, none far under its best; the rest fills the set."""
    w = Window.partitionBy("alias").orderBy(F.desc(F.round("score", 9)), "path", "line", "hit")
    x = _ranked_set(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 20")
    return C.diversify(x, "alias", ["alias", "path", "line", "hit"], 25).select("alias", "hit", "kept", r6("score").alias("score"))


@query("select evidence_id, f.path from (select concat('doc:', doc_id::varchar) as evidence_id, concat('scope', (doc_id % 3)::varchar) as scope, (doc_id % 200)::varchar as file_id from documents) e join code_files f using (scope, file_id)", "code_files")
def evidence_file_links(spark, d):
    """Knowledge evidence and the code file it names, by scope and file."""
    e = view(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("evidence_id"), F.concat(F.lit("scope"), (F.col("doc_id") % 3).cast("string")).alias("scope"), (F.col("doc_id") % 200).cast("string").alias("file_id"))
    return e.join(view(spark, d, "code_files").select("scope", "file_id", "path"), ["scope", "file_id"]).select("evidence_id", "path")


@query("select alias, priority, count(*)::bigint as files, count(*) filter (parse_status = 'degraded')::bigint as degraded, bool_or(stale) as stale from repo_members join code_files using (scope) group by alias, priority", "repo_members", "code_files")
def member_status(spark, d):
    x = view(spark, d, "code_files").join(F.broadcast(view(spark, d, "repo_members")), "scope")  # three members
    return x.groupBy("alias", "priority").agg(F.count("*").alias("files"), F.count_if(F.col("parse_status") == "degraded").alias("degraded"), F.bool_or("stale").alias("stale"))


@query(f"select route_id, url, http_method, round(score, 6) as score from (select *, {score_sql('handler_7 post', ['url', 'http_method', 'handler'])} as score from code_routes) x where http_method = 'POST' and x.score > 0 order by round(x.score, 9) desc, route_id limit 100", "code_routes")
def route_search(spark, d):
    """A method token in the query is a filter as well as a term."""
    from pyspark.sql.functions import lit

    q = "handler_7 post"
    method = [w for w in q.split() if w.upper() in P.METHODS]
    r = view(spark, d, "code_routes").where(F.col("http_method") == P.http_method(lit(method[0])))
    s = T.score_query(q, [F.col(c) for c in ("url", "http_method", "handler")])
    return r.withColumn("score", s).where("score > 0").orderBy(F.desc(F.round("score", 9)), "route_id").limit(100).select("route_id", "url", "http_method", r6("score").alias("score"))


@query("select scope, coalesce(sum(case when parse_status = 'parsed' then n end), 0)::bigint as parsed, coalesce(sum(case when parse_status = 'degraded' then n end), 0)::bigint as degraded from (select scope, parse_status, count(*) as n from code_files group by all) x group by scope", "code_files")
def parse_status_counts(spark, d):
    return view(spark, d, "code_files").groupBy("scope").pivot("parse_status", ["parsed", "degraded"]).count().na.fill(0)


@query(f"""with {_CROSS}, h as (select import_id as hit, file_id from code_imports where file_id::bigint < 120), e as (select edges.*, i.file_id as from_file from edges join code_imports i using (import_id) where state = 'resolved' and to_file in (select file_id from h))
  select hit, round(least(0.70, sum(confidence / 10000.0 * 0.35)), 6)::double as bonus from h join e on h.file_id = e.from_file group by hit""", "code_files", "code_imports")
def bridge_bonus(spark, d):
    i = view(spark, d, "code_imports")
    hits = i.where("cast(file_id as bigint) < 120").select(F.col("import_id").alias("hit"), "file_id")
    e = cross_repo_edges(spark, d).join(i.select("import_id", F.col("file_id").alias("from_file")), "import_id")
    return C.bridge_bonus(hits, e).withColumn("bonus", r6("bonus"))


@query("select call_id, trim(coalesce(list_filter(string_split(k.content, chr(10)), lambda x: contains(x, callee))[1], string_split(k.content, chr(10))[1])) as excerpt from code_calls c join (select symbol_id, replace(content, ' in ', chr(10)) as content from code_chunks) k on k.symbol_id = c.caller_id", "code_calls", "code_chunks")
def call_excerpts(spark, d):
    k = view(spark, d, "code_chunks").select(F.col("symbol_id").alias("caller_id"), F.replace("content", F.lit(" in "), F.lit("\n")).alias("content"))
    return view(spark, d, "code_calls").join(k, "caller_id").select("call_id", C.focused_excerpt(F.col("content"), F.col("callee")).alias("excerpt"))


@query("with e as (select path, byte_len, case when file_id::bigint % 7 = 0 then 'missing' else 'indexed' end as was from code_files where file_id::bigint % 4 <> 0), o as (select path, byte_len + 1 as byte_len from code_files where file_id::bigint % 3 <> 0) select path, coalesce(o.byte_len, e.byte_len) as byte_len, case when o.byte_len is not null then 'indexed' else 'missing' end as status from e full join o using (path)", "code_files")
def file_index_scan(spark, d):
    """A complete scan: seen files are indexed, unseen ones missing."""
    f = view(spark, d, "code_files").withColumn("k", F.col("file_id").cast("long"))
    known = f.where("k % 4 <> 0").select("path", "byte_len", F.when(F.col("k") % 7 == 0, "missing").otherwise("indexed").alias("status"))
    return store.file_index(known, f.where("k % 3 <> 0").select("path", (F.col("byte_len") + 1).alias("byte_len")), True)


@query("with w as (select scope, file_id, row_number() over (partition by scope order by path) - 1 as n, sum(byte_len) over (partition by scope order by path rows unbounded preceding) - byte_len as b from code_files) select scope, file_id, greatest(floor(n / 40), floor(b / 500000))::bigint as batch from w", "code_files")
def index_batches(spark, d):
    return store.batches(view(spark, d, "code_files"), 40, 500_000).select("scope", "file_id", F.col("batch").cast("long").alias("batch"))


@query("select import_id, contains('.' || regexp_replace(module, '::|/', '.', 'g') || '.', '.brand7.') as bounded, regexp_matches(module, '^(\\.|crate::|self::|super::)') as relative from code_imports", "code_imports")
def module_boundaries(spark, d):
    return view(spark, d, "code_imports").select("import_id", P.module_contains(F.col("module"), F.lit("brand7")).alias("bounded"), P.is_relative_module(F.col("module")).alias("relative"))


@query("""with recursive p as (select concat('p', p_partkey) as project, case when p_partkey > 20 then concat('p', p_partkey - 20) end as parent from part),
  a(project, anc, d) as (select project, project, 0 from p union all select a.project, p.parent, d + 1 from a join p on p.project = a.anc where p.parent is not null),
  props as (select concat('p', p_partkey) as project, 'v' as name, p_size::varchar as value from part where p_partkey % 3 = 0),
  man as (select concat('p', p_partkey) as project, 'lib' as artifact, '${v}' as version from part where p_partkey <= 20), dep as (select concat('p', p_partkey) as project, 'lib' as artifact, case when p_partkey % 11 = 0 then concat('1.', p_size) end as version from part where p_partkey % 2 = 0),
  np as (select a.project, name, arg_min(value, d) as value from a join props on props.project = a.anc group by all), nm as (select a.project, artifact, arg_min(version, d) as version from a join man on man.project = a.anc group by all),
  mine as (select a.project, artifact, arg_min(version, d) filter (version is not null) as own from a join dep on dep.project = a.anc group by all), x as (select project, artifact, coalesce(own, nm.version) as raw from mine left join nm using (project, artifact))
  select x.project, artifact, case when raw = '${v}' then np.value else raw end as version from x left join np on np.project = x.project and np.name = 'v'""")
def effective_versions(spark, d):
    """Inherited versions through parent chains of any length."""
    from ..operators import software as Sw

    part = view(spark, d, "part")
    k, name = F.col("p_partkey"), lambda x: F.concat(F.lit("p"), x.cast("string"))
    projects = part.select(name(k).alias("project"), F.when(k > 20, name(k - 20)).alias("parent"))
    props = part.where("p_partkey % 3 = 0").select(name(k).alias("project"), F.lit("v").alias("name"), F.col("p_size").cast("string").alias("value"))
    managed = part.where("p_partkey <= 20").select(name(k).alias("project"), F.lit("lib").alias("artifact"), F.lit("${v}").alias("version"))
    deps = part.where("p_partkey % 2 = 0").select(name(k).alias("project"), F.lit("lib").alias("artifact"), F.when(k % 11 == 0, F.concat(F.lit("1."), F.col("p_size").cast("string"))).alias("version"))
    return Sw.effective_models(projects, props, managed, deps)
