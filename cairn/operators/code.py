"""Resolution passes, searches and impact over a code graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..sources.adapter import by_keys
from ..sources.scratch import cut
from . import scoring as Sc

CALLABLE = ["function", "method", "macro", "constructor"]
LAYERS = {"symbol": (40, 200, 800), "reference": (35, 200, 700), "call": (40, 250, 800), "caller": (100, 500, 1000), "import": (35, 200, 700), "sbom": (35, 200, 700), "chunk": (45, 300, 900)}


def layer_limit(layer: str, limit: int) -> int:
    times, low, high = LAYERS[layer]
    return min(max(limit * times, low), high)


def per_member_limit(limit: int, members: int, budget: int = 400) -> int:
    return max(limit, min(limit * 4, budget // max(1, members)))


@dataclass
class Filters:
    """Qualifiers of a query, kind: lang: path: name:, and the text that is left. A token with :: is never one."""

    text: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    exclude_generated: bool = False


def parse_query(query: str) -> Filters:
    f, words = Filters(), []
    target = {"kind": f.kinds, "lang": f.languages, "language": f.languages, "path": f.paths, "name": f.names}
    for token in query.split():
        key, colon, value = token.partition(":")
        if colon and value and not value.startswith(":") and key in target:
            target[key] += [v for v in value.split(",") if v]
        else:
            words.append(token)
    f.text = " ".join(words)
    return f


def selected(f: Filters, path: Column, lang: Column, generated: Column) -> Column:
    """Rows that pass the filters; they are applied before any top-n so that limits count only what can be returned."""
    sub = lambda c, many: F.lit(not many) | (sum((F.when(F.lower(c).contains(x.lower()), 1).otherwise(0) for x in many), F.lit(0)) > 0)
    return P.language_allows(path, lang, f.languages) & sub(path, f.paths) & (~generated if f.exclude_generated else F.lit(True))


def generated_score(score: Column, generated: Column) -> Column:
    return F.when(generated, score * 0.35).otherwise(score)


def kind_bonus(kind: Column) -> Column:
    return F.when(kind == "macro", 0.35).when(kind.isin("function", "method"), 0.25).when(kind == "function_declaration", 0.0).otherwise(0.1)


def resolve_references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Unique name: resolved, 8000; unique (name, path): resolved, 8000; a known name: ambiguous, 5000; else unresolved, 2500.

    Definitions are reduced to one row a name (and a name and path) before they meet the references."""
    one = lambda *k: symbols.groupBy("scope", *k).agg(F.count("*").alias("c"), F.min("symbol_id").alias("target"))
    # cut, so that the join knows its size: few names are sent to the references, which then are dealt out for paths alone
    by_name = cut(one("name").select("scope", "name", F.col("c").alias("cn"), F.col("target").alias("tn")), "names")
    by_path = one("name", "path").where("c = 1").select("scope", "name", "path", F.col("target").alias("tp"))
    x = refs.select("scope", "ref_id", "name", "path").join(by_name, ["scope", "name"], "left").join(by_keys(by_path), ["scope", "name", "path"], "left")
    target = F.coalesce(F.when(F.col("cn") == 1, F.col("tn")), F.col("tp"))
    state = F.when(target.isNotNull(), "resolved").when(F.col("cn").isNotNull(), "ambiguous").otherwise("unresolved")
    points = F.when(target.isNotNull(), 8000).when(F.col("cn").isNotNull(), 5000).otherwise(2500)
    return x.select("ref_id", target.alias("target"), state.alias("state"), points.alias("confidence"))


def resolve_calls(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """The only callable of a name; else the only one in the same path; else ambiguous."""
    return resolve_references(refs.where("kind = 'call'"), symbols.where(F.col("kind").isin(CALLABLE)))


RADIX = 64


def innermost(lines: DataFrame, spans: DataFrame, key: str, best: Column, pick=F.max) -> DataFrame:
    """(key, best): of the spans (file_id, line_start, line_end) that cover a line (key, file_id, line), the greatest (or what ``pick`` picks) ``best``.

    Spans are cut into aligned blocks of 1, 64, 4096 ... lines, and only the best of a block goes on: a line
    then meets one row for each size of blocks, however many spans a file has or however they overlap."""
    longest = spans.agg(F.max("line_end")).first()[0] or 0
    first, end = F.col("line_start"), F.col("line_end") + 1
    up, down = lambda x, n: F.ceil(x / n).cast("long"), lambda x, n: F.floor(x / n).cast("long")
    range_ = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<long>"))
    blocks, size, level, at = [], 1, 0, []
    while True:
        inner = (up(first, size * RADIX) * RADIX, down(end, size * RADIX) * RADIX)
        lo, hi = up(first, size), down(end, size)
        own = F.when(inner[0] < inner[1], F.concat(range_(lo, inner[0]), range_(inner[1], hi))).otherwise(range_(lo, hi))
        top = size * RADIX > longest
        blocks.append(F.transform(range_(lo, hi) if top else own, lambda x: F.struct(F.lit(level).alias("level"), x.alias("block"))))  # noqa: B023
        at.append(F.struct(F.lit(level).alias("level"), down(F.col("line"), size).alias("block")))
        if top:
            break
        size, level = size * RADIX, level + 1
    # dealt out first: blocks of one span are never equal, so a task would only sort them all to find few alike
    each = spans.where("line_start <= line_end").select("file_id", F.inline(F.concat(*blocks)), best.alias("best")).repartition("file_id", "level", "block")
    few = each.groupBy("file_id", "level", "block").agg(pick("best").alias("best"))
    x = lines.select(key, "file_id", F.inline(F.array(*at))).join(by_keys(few), ["file_id", "level", "block"])
    return x.groupBy(key).agg(pick("best").alias("best"))


def enclosing(lines: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """The innermost symbol that covers a line: latest start, then earliest end, then greatest name."""
    best = F.struct("line_start", (-F.col("line_end")).alias("e"), F.col("name").alias("symbol"), "symbol_id")
    return innermost(lines, symbols, key, best).select(key, "best.symbol_id", "best.symbol")


def innermost_chunks(lines: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """The chunk of fewest lines that covers a line, then the least id."""
    best = F.struct((F.col("line_end") - F.col("line_start")).alias("n"), "chunk_id")
    return innermost(lines, chunks, key, best, F.min).select(key, "best.chunk_id")


def search_symbols(symbols: DataFrame, f: Filters, limit: int, query_kind: str = "symbol") -> DataFrame:
    rows = symbols.where(selected(f, F.col("path"), F.col("language_id"), F.col("is_generated")))
    rows = rows.where(F.col("kind").isin(f.kinds)) if f.kinds else rows
    base = T.score_query(f.text, [F.col("name"), F.col("path"), F.col("kind")])
    score = generated_score(base + T.exact_path(f.text, F.col("path")) + kind_bonus(F.col("kind")) + Sc.symbol_paths(F.col("path"), F.col("kind"), f.text, query_kind), F.col("is_generated"))
    return hits(rows.withColumn("base", base).where("base > 0").select("symbol_id", "path", F.col("line_start").alias("line"), score.alias("score")), "symbol_id", limit)


def search_references(refs: DataFrame, text: str, limit: int) -> DataFrame:
    """References whose name or path the text fits, 1.5 above the text's own score, and by what their paths are for."""
    # a name stands at many places and a path has many names: each is scored once
    points = lambda c: refs.select(c).distinct().select(F.col(c).alias(f"the_{c}"), T.token_points(text, F.col(c)).alias(f"of_{c}"))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"the_{c}"))
    x = refs.join(points("name"), same("name")).join(points("path"), same("path")).withColumn("b", T.sum_points([F.col("of_name"), F.col("of_path")])).where("b > 0")
    return hits(x.select("ref_id", "path", "line", (F.col("b") + 1.5 + Sc.reference_paths(F.col("path"), text)).alias("score")), "ref_id", limit)


def search_imports(imports: DataFrame, text: str, limit: int, query_kind: str = "imports") -> DataFrame:
    """Imports whose module or path the text fits, by what their paths are for and how they are written."""
    s = T.score_query(text, [F.col("module"), F.col("path")])
    x = imports.withColumn("b", s).where("b > 0")
    return hits(x.select("import_id", "path", "line", "module", (F.col("b") + Sc.import_shape(F.col("path"), F.col("module"), F.col("line"), text, query_kind)).alias("score")), "import_id", limit)


def search_chunks(chunks: DataFrame, f: Filters, limit: int, query_kind: str = "symbol") -> DataFrame:
    """Chunks with every term; in mixed searches those with terms near each other go up."""
    x = chunks.where(selected(f, F.col("path"), F.col("language_id"), F.col("is_generated")))
    for w in f.text.lower().split():
        x = x.where(F.lower("content").contains(w))
    x = x.withColumn("b", T.score_query(f.text, [F.col("content"), F.col("path")])).where("b > 0")
    near = Sc.proximity(F.col("b"), F.col("content"), F.col("path"), f.text) if query_kind == "hybrid" else F.lit(0.0)
    return hits(x.select("chunk_id", "path", F.col("line_start").alias("line"), generated_score(F.col("b") + near, F.col("is_generated")).alias("score")), "chunk_id", limit)


def search_calls(calls: DataFrame, column: str, name: str, limit: int) -> DataFrame:
    """Calls by callee or caller name: 4.0, a quarter for each further site of the same caller and callee, three at most, and by what their paths are for."""
    x = calls.where(F.lower(column) == name.strip().lower())
    n = x.groupBy("caller_id", "callee").agg(F.count("*").alias("n"))
    x = x.join(n, ["caller_id", "callee"]).withColumn("score", 4.0 + F.least(F.col("n") - 1, F.lit(3)) * 0.25 + Sc.call_paths(F.col("path"), name, column == "callee"))
    return hits(x.select("call_id", "caller", "path", "line", "score"), "call_id", limit)


def feature_flags(flags: DataFrame, text: str = "") -> DataFrame:
    """(scope, name, score, usages): flags whose name has every word, with their usages in order."""
    s = F.when(F.col("edge_kind") == "guards_code", 20).when(F.col("edge_kind") == "defines_config", 16).otherwise(12) + F.col("confidence") / 1000 + (8 if text else 0)
    for w in text.lower().split():
        flags = flags.where(F.lower("name").contains(w))
    return flags.groupBy("scope", "name").agg(F.max(s).alias("score"), F.array_sort(F.collect_list(F.struct("line", "usage_id", "file_id"))).alias("usages"))


def saturated(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows, and whether there are more: one row beyond the limit tells."""
    few = rows.orderBy(*order).limit(limit + 1)
    x = few.withColumn("n", F.row_number().over(Window.orderBy(*order))).withColumn("saturated", F.max("n").over(Window.partitionBy()) > limit)
    return x.where(F.col("n") <= limit).drop("n")


def diversify(rows: DataFrame, member: str, order: list[str], limit: int, most: int = 3, share: float = 0.45, gap: float = 10.0) -> DataFrame:
    """Rows (score, rank r within a member) of a set, limit at most: first up to three of each member that aren't far
    under its best, by score, then the others, so that a set of few members is still filled."""
    best = rows.groupBy(member).agg(F.max("score").alias("best"))
    x = rows.join(best, member).withColumn("kept", (F.col("r") <= most) & (F.col("score") >= F.greatest(F.col("best") * share, F.col("best") - gap)))
    return x.orderBy(F.desc("kept"), F.desc(F.round("score", 9)), *order).limit(limit).drop("best")


def hits(rows: DataFrame, id_col: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(F.round("score", 9)), "path", "line", id_col).limit(limit)


def dedupe_best(rows: DataFrame) -> DataFrame:
    """One hit for each (path, line, excerpt): the best score, layers united."""
    return rows.groupBy("path", "line", "excerpt").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("layers")))).alias("layers"))


def cross_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Unresolved, non-relative imports against other scopes' modules: 1 candidate resolved, several ambiguous, none unresolved."""
    keys = files.select("scope", F.col("file_id").alias("f"), F.explode(P.module_keys(F.col("path"))).alias("module"))
    # of each module: its files by the one scope that has them, so a common module is a few counts, not its files
    of_file = keys.groupBy("module", "f").agg(F.min("scope").alias("lo"), F.max("scope").alias("hi"))
    counts = of_file.groupBy("module", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("only")).agg(F.count("*").alias("n"), F.min("f").alias("f"))
    open_ = imports.where((F.col("resolution") == "unresolved") & ~P.is_relative_module(F.col("module"))).select("scope", "import_id", "module")
    found = open_.select("scope", "module").distinct().join(by_keys(counts), "module").where("only is null or only <> scope").groupBy("scope", "module").agg(F.sum("n").alias("c"), F.min("f").alias("to_file"))
    x = open_.join(found, ["scope", "module"], "left")
    state = F.when(F.col("c") == 1, "resolved").when(F.col("c") > 1, "ambiguous").otherwise("unresolved")
    points = F.when(F.col("c") == 1, 10000).when(F.col("c") > 1, 5000).otherwise(0)
    return x.select("scope", "import_id", F.when(F.col("c") == 1, F.col("to_file")).alias("to_file"), state.alias("state"), points.alias("confidence"))


def impact(changed: DataFrame, deleted: DataFrame, chunks: DataFrame, calls: DataFrame, symbols: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, kind, score): chunks of changed paths 4.0, callers 2.5, importers 2.0; generated x 0.35, then + 3.0."""
    gen = files.select("path", "is_generated")
    c = chunks.join(changed, "path", "left_semi").select("path", F.col("line_start").alias("line"), F.lit("changed").alias("kind"), F.lit(4.0).alias("s"))
    known = symbols.join(changed, "path", "left_semi").select(F.col("name").alias("callee"))
    names = known.union(deleted.select(F.col("name").alias("callee"))).distinct()
    callers = calls.join(names, "callee", "left_semi").join(changed, "path", "left_anti").select("path", "line", F.lit("caller"), F.lit(2.5))
    keys = changed.select(F.explode(P.module_keys(F.col("path"))).alias("module")).distinct()
    importers = imports.join(keys, "module", "left_semi").select("path", "line", F.lit("importer"), F.lit(2.0))
    x = c.union(callers).union(importers).distinct().join(gen, "path", "left")
    return x.select("path", "line", "kind", (generated_score(F.col("s"), F.coalesce("is_generated", F.lit(False))) + 3.0).alias("score"))


def running_bytes(rows: DataFrame, size: Column, order: list[Column], budget: int) -> DataFrame:
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bytes", size.cast("long")).withColumn("running", F.sum("bytes").over(w)).where(F.col("running") <= budget)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, to_file, state, confidence): a module that is one file's key in its scope is that file; several are ambiguous."""
    keys = files.select("scope", F.col("file_id").alias("to_file"), F.explode(P.module_keys(F.col("path"))).alias("module"))
    # a module's files are counted before imports meet them: a common module's imports times its files would be no bound
    counts = keys.distinct().groupBy("scope", "module").agg(F.count("*").alias("n"), F.min("to_file").alias("f"))
    one = (F.max("n") == 1) & (F.min("f") == F.max("f"))
    found = imports.select("scope", "import_id", "module").join(by_keys(counts), ["scope", "module"]).groupBy("import_id").agg(F.when(one, 1).otherwise(2).alias("c"), F.min("f").alias("f"))
    x = imports.select("import_id").join(found, "import_id", "left")
    state = F.when(F.col("c") == 1, "resolved").when(F.col("c") > 1, "ambiguous").otherwise("unresolved")
    points = F.when(F.col("c") == 1, 10000).when(F.col("c") > 1, 5000).otherwise(0)
    return x.select("import_id", F.when(F.col("c") == 1, F.col("f")).alias("to_file"), state.alias("state"), points.alias("confidence"))


def resolve_through_imports(refs: DataFrame, imports: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, target): references to a name that one file imported by the reference's own file defines once."""
    to = resolve_imports(imports, files).where("state = 'resolved'").join(imports.select("import_id", "file_id"), "import_id").select("file_id", "to_file").distinct()
    once = symbols.groupBy(F.col("file_id").alias("to_file"), "name").agg(F.count("*").alias("c"), F.min("symbol_id").alias("target")).where("c = 1").drop("c")
    hits = refs.select("ref_id", "file_id", "name").join(to, "file_id").join(by_keys(once), ["to_file", "name"])
    return hits.groupBy("ref_id").agg(F.count_distinct("target").alias("c"), F.min("target").alias("target")).where("c = 1").drop("c")


def workspace_imports(imports: DataFrame, members: DataFrame) -> DataFrame:
    """(import_id, member): the workspace member whose package name is the longest prefix of the module, at separators."""
    seg = F.split(F.regexp_replace("module", "::|/", "."), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(seg)), lambda i: F.array_join(F.slice(seg, 1, i), "."))
    x = imports.select("import_id", F.explode(prefixes).alias("package")).join(members.select("package", "member"), "package")
    return x.groupBy("import_id").agg(F.max_by("member", F.struct(F.length("package"), "member")).alias("member"))


def overlay_evidence(hits: DataFrame, edges: DataFrame, cap: int = 3) -> DataFrame:
    """(hit, import_id, via): cross edges of a hit, by its own import first, then by its file, at most ``cap`` each."""
    own = hits.select(F.col("id").alias("hit"), "file_id").join(edges, F.col("hit") == F.col("import_id")).select("hit", "import_id", F.lit(0).alias("via"), "confidence")
    # of a file's edges only those can count that are among its first, the hit's own apart: not all meet all hits of the file
    first = F.dense_rank().over(Window.partitionBy("from_file").orderBy(F.desc("confidence"), "import_id"))
    few = edges.select("import_id", "from_file", "confidence").withColumn("r", first).where(F.col("r") <= cap + 1).drop("r")
    file = hits.select(F.col("id").alias("hit"), "file_id").join(few.withColumnRenamed("from_file", "file_id"), "file_id").where("import_id <> hit").select("hit", "import_id", F.lit(1), "confidence")
    w = Window.partitionBy("hit").orderBy("via", F.desc("confidence"), "import_id")
    return own.union(file).withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).select("hit", "import_id", "via")


def pick_scope(scopes: DataFrame, filters: DataFrame) -> DataFrame:
    """(repository, scope): the newest indexed scope whose path filters hold all that a request names; none means everything."""
    x = scopes.join(filters, "repository")
    covers = (F.size("path_filters") == 0) | (F.size(F.array_except("wanted", "path_filters")) == 0)
    return x.where(covers).groupBy("repository").agg(F.max_by("scope", F.struct("version", "scope")).alias("scope"))


def bridge_bonus(hits: DataFrame, edges: DataFrame, each: float = 0.35, cap: float = 0.70) -> DataFrame:
    """(hit, bonus): resolved edges from a hit's file to a file that the result holds too, by confidence, capped."""
    files = hits.select("file_id").distinct()
    inside = edges.where("state = 'resolved'").join(files.withColumnRenamed("file_id", "to_file"), "to_file", "left_semi")
    # a file's edges are summed before its hits meet them
    of_file = inside.groupBy(F.col("from_file").alias("file_id")).agg(F.sum(F.col("confidence") / 10000 * each).alias("sum"))
    return hits.select("hit", "file_id").join(of_file, "file_id").groupBy("hit").agg(F.least(F.lit(cap), F.sum("sum")).alias("bonus"))


def focused_excerpt(content: Column, name: Column) -> Column:
    """The first line that holds a name, trimmed; the first line if none does."""
    lines = F.split(content, "\n")
    return F.trim(F.coalesce(F.get(F.filter(lines, lambda x: x.contains(name)), F.lit(0)), F.get(lines, F.lit(0))))
