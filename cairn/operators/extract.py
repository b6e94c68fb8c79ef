"""Facts from source files: symbols, references, imports, chunks, dependencies, flags, routes, workspaces, config keys.

One ``mapInPandas`` pass over (scope, file_id, path, content) yields rows of one long schema; each kind
is a filter of it. Python is parsed by its own grammar, other languages by patterns; a file that doesn't
parse is kept as text only, with the reason. No native parser is needed, nor a shuffle.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "scope string, file_id string, path string, fact string, name string, kind string, detail string, line_start long, line_end long, content string"
CHUNK_BYTES, CHUNK_LINES = 8000, 200
WHOLE_LANGUAGES = set("cmake dockerfile gomod gotemplate ini jinja2 json make markdown ninja properties starlark toml xml yaml".split())
WHOLE_MANIFESTS = {"go.mod", "go.work", "package.json", "pnpm-workspace.yaml", "pnpm-workspace.yml"}
_SOURCE = re.compile(r"[\w#@]")

_SYMBOLS = {
    "rust": [(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "function"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "struct"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "enum"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", "trait"), (r"^\s*macro_rules!\s+(\w+)", "macro")],
    "go": [(r"^func\s+\([^)]*\)\s*(\w+)", "method"), (r"^func\s+(\w+)", "function"), (r"^type\s+(\w+)\s+(?:struct|interface)", "class")],
    "java": [(r"^\s*(?:public|private|protected)?\s*(?:abstract\s+|final\s+)?(?:class|interface|enum|record)\s+(\w+)", "class"), (r"^\s+(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\], ]+\s+(\w+)\s*\([^;]*$", "method")],
    "typescript": [(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)", "function"), (r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"^\s*(?:export\s+)?interface\s+(\w+)", "interface"), (r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(", "function")],
    "c": [(r"^[A-Za-z_][\w\s\*]*?\b(\w+)\s*\([^;]*\)\s*\{", "function"), (r"^\s*#define\s+(\w+)", "macro"), (r"^(?:typedef\s+)?struct\s+(\w+)", "struct")],
    "ruby": [(r"^\s*def\s+(?:self\.)?(\w+[?!]?)", "method"), (r"^\s*class\s+(\w+)", "class"), (r"^\s*module\s+(\w+)", "module")],
    "bash": [(r"^\s*(?:function\s+)?(\w+)\s*\(\)", "function")],
    "sql": [(r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:table|view|function)\s+(?:if\s+not\s+exists\s+)?(\w+)", "relation")],
    "markdown": [(r"^#{1,6}\s+(.+?)\s*#*$", "heading")],
}
for _a, _b in (("javascript", "typescript"), ("jsx", "typescript"), ("tsx", "typescript"), ("cpp", "c"), ("kotlin", "java"), ("scala", "java"), ("csharp", "java"), ("php", "typescript"), ("swift", "typescript")):
    _SYMBOLS[_a] = _SYMBOLS[_b]
_SYMBOLS["kotlin"] = [(r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(\w+)", "function"), *_SYMBOLS["java"][:1]]
_SYMBOLS["swift"] = [(r"^\s*(?:\w+\s+)*func\s+(\w+)", "function"), (r"^\s*(?:\w+\s+)*(?:class|struct|enum|protocol)\s+(\w+)", "class")]
_IMPORTS = {
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "python": r"", "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"]+)\"\s*$", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "kotlin": r"^\s*import\s+([\w.]+)", "scala": r"^\s*import\s+([\w.]+)",
    "typescript": r"(?:from|require\(|import)\s*['\"]([^'\"]+)['\"]", "c": r"^\s*#include\s+[<\"]([^>\"]+)[>\"]", "csharp": r"^\s*using\s+([\w.]+);", "ruby": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", "php": r"^\s*use\s+([\w\\]+)", "swift": r"^\s*import\s+(\w+)", "bash": r"^\s*(?:source|\.)\s+(\S+)",
}
for _a, _b in (("javascript", "typescript"), ("jsx", "typescript"), ("tsx", "typescript"), ("cpp", "c")):
    _IMPORTS[_a] = _IMPORTS[_b]
_KEYWORDS = set("if for while switch return catch match fn func def function sizeof print class struct elif else with except lambda and or not in is new await async".split())
_FLAGS = [
    (r"(?:os\.environ(?:\.get)?[\[(]|os\.getenv\(|process\.env\.|process\.env\[|env::var\(|System\.getenv\(|os\.Getenv\(|ENV\[)\s*['\"]?([A-Za-z_][A-Za-z0-9_]*)", "env", "reads_config"),
    (r"(?:is_enabled|isEnabled|feature_enabled|variation|getFlag|flag)\(\s*['\"]([\w.-]+)['\"]", "sdk", "guards_code"),
    (r"^\s*#\s*if(?:n?def)?\s+(?:defined\s*\(?\s*)?([A-Za-z_]\w*)", "preprocessor", "guards_code"),
    (r"#\[cfg\(feature\s*=\s*\"([\w-]+)\"", "cargo_feature", "guards_code"),
    (r"(?i)^\s*[\"']?((?:[\w.-]*\.)?(?:feature|flag|enable)[\w.-]*)[\"']?\s*[:=]\s*(?:true|false|\"|'|\d)", "config", "defines_config"),
]
_ROUTES = [
    (r"@\w+\.route\(\s*['\"]([^'\"]+)['\"](?:[^)]*methods\s*=\s*\[\s*['\"](\w+)['\"])?", "flask", None),
    (r"@\w+\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]", "fastapi", "first"),
    (r"\b(?:app|router|server)\.(get|post|put|patch|delete|all)\(\s*['\"`]([^'\"`]+)['\"`]", "express", "first"),
    (r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]+)\"", "spring", "first"),
    (r"@RequestMapping\(\s*(?:value\s*=\s*)?\"([^\"]+)\"(?:[^)]*RequestMethod\.(\w+))?", "spring", None),
]


def _python(content: str) -> Iterator[tuple]:
    tree = ast.parse(content)

    def walk(node, inside: bool):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                yield "symbol", child.name, "class" if is_class else "method" if inside else "function", ast.get_docstring(child) or "", child.lineno, child.end_lineno
                yield from walk(child, is_class)
            else:
                if isinstance(child, ast.Call):
                    name = child.func.attr if isinstance(child.func, ast.Attribute) else getattr(child.func, "id", None)
                    if name:
                        yield "reference", name, "call", "", child.lineno, child.lineno
                elif isinstance(child, ast.Import):
                    for a in child.names:
                        yield "import", a.name, "module", a.asname or "", child.lineno, child.lineno
                elif isinstance(child, ast.ImportFrom):
                    base = "." * child.level + (child.module or "")
                    for a in child.names:
                        yield "import", base, "symbol", a.name, child.lineno, child.lineno
                yield from walk(child, inside)

    yield from walk(tree, False)


def _patterns(lang: str, lines: list[str]) -> Iterator[tuple]:
    found = []
    for n, line in enumerate(lines, 1):
        for pattern, kind in _SYMBOLS.get(lang, []):
            if m := re.match(pattern, line):
                if m[1] not in _KEYWORDS:
                    found.append((m[1], kind, n))
                break
        else:
            for m in re.finditer(r"\b([A-Za-z_]\w*)\s*\(", line if lang in _IMPORTS else ""):
                if m[1] not in _KEYWORDS:
                    yield "reference", m[1], "call", "", n, n
        if (p := _IMPORTS.get(lang)) and (m := re.search(p, line)):
            yield "import", m[1], "module", "", n, n
    for i, (name, kind, n) in enumerate(found):
        end = found[i + 1][2] - 1 if i + 1 < len(found) else len(lines)
        yield "symbol", name, kind, "", n, max(n, end)


def dependencies(path: str, content: str) -> Iterator[tuple]:
    """(name, ecosystem, requirement, line, is_lockfile) of manifests and lockfiles."""
    base = path.rsplit("/", 1)[-1].lower()
    lines = content.splitlines()
    at = lambda name: next((n for n, x in enumerate(lines, 1) if name in x), 1)
    if base in ("package.json", "package-lock.json"):
        data = json.loads(content)
        if base == "package-lock.json":
            for k, v in (data.get("packages") or {}).items():
                if k:
                    yield k.split("node_modules/")[-1], "npm", v.get("version", ""), at(k), True
        else:
            for group in ("dependencies", "devDependencies", "peerDependencies"):
                for k, v in (data.get(group) or {}).items():
                    yield k, "npm", str(v), at(f'"{k}"'), False
    elif base in ("cargo.toml", "pyproject.toml", "cargo.lock"):
        import tomllib

        data = tomllib.loads(content)
        if base == "cargo.lock":
            for p in data.get("package", []):
                yield p["name"], "cargo", p.get("version", ""), at(f'"{p["name"]}"'), True
        elif base == "cargo.toml":
            for group in ("dependencies", "dev-dependencies", "build-dependencies"):
                for k, v in data.get(group, {}).items():
                    yield k, "cargo", v if isinstance(v, str) else str(v.get("version", "")), at(k), False
        else:
            for d in data.get("project", {}).get("dependencies", []):
                if m := re.match(r"\s*([\w.-]+)\s*(.*)", d):
                    yield m[1], "python", m[2], at(m[1]), False
    elif re.fullmatch(r"requirements.*\.txt", base):
        for n, x in enumerate(lines, 1):
            if m := re.match(r"\s*([\w.-]+)\s*([=<>!~][^#;]*)?", x):
                yield m[1], "python", (m[2] or "").strip(), n, False
    elif base == "go.mod":
        for n, x in enumerate(lines, 1):
            if m := re.match(r"\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+(v\S+)", x):
                yield m[1], "go", m[2], n, False
    elif base == "go.sum":
        for n, x in enumerate(lines, 1):
            if (m := re.match(r"(\S+)\s+(v[^\s/]+)(?:/go\.mod)?\s", x)) and "/go.mod " not in x:
                yield m[1], "go", m[2], n, True
    elif base == "pom.xml":
        for m in re.finditer(r"<dependency>\s*<groupId>(.*?)</groupId>\s*<artifactId>(.*?)</artifactId>(?:\s*<version>(.*?)</version>)?", content, re.S):
            yield f"{m[1]}:{m[2]}", "maven", m[3] or "", content[: m.start()].count("\n") + 1, False
    elif base in ("build.gradle", "build.gradle.kts"):
        for n, x in enumerate(lines, 1):
            if m := re.search(r"(?:implementation|api|testImplementation)\s*\(?['\"]([\w.-]+:[\w.-]+):?([\w.-]*)['\"]", x):
                yield m[1], "maven", m[2], n, False
    elif base == "conanfile.txt":
        for n, x in enumerate(lines, 1):
            if m := re.match(r"\s*([\w.-]+)/([\w.]+)", x):
                yield m[1], "conan", m[2], n, False
    elif base == "cmakelists.txt":
        for n, x in enumerate(lines, 1):
            if m := re.search(r"find_package\(\s*(\w+)\s*([\d.]*)", x):
                yield m[1], "cmake", m[2], n, False


def config_facts(lang: str, lines: list[str]) -> Iterator[tuple]:
    """(key, kind, value, line) of key-value, variable and boolean lines of configuration files."""
    section = ""
    for n, x in enumerate(lines, 1):
        if m := re.match(r"\s*\[+([^\]]+)\]+\s*$", x):
            section = m[1] + "."
        elif m := re.match(r"\s*[\"']?([A-Za-z_][\w.-]*)[\"']?\s*[:=]\s*(.*?),?\s*$", x):
            value = m[2].strip("\"'")
            yield section + m[1], "boolean" if value.lower() in ("true", "false") else "key", value, n
        for v in re.findall(r"\$\{(\w+)[^}]*\}|\{\{\s*([\w.]+)\s*\}\}", x):
            yield v[0] or v[1], "variable", "", n


def workspaces(path: str, content: str) -> Iterator[tuple]:
    """(member pattern, kind) of monorepo manifests."""
    base = path.rsplit("/", 1)[-1].lower()
    if base == "pnpm-workspace.yaml":
        for m in re.finditer(r"^\s*-\s*['\"]?([^'\"\n]+)", content, re.M):
            yield m[1].strip(), "pnpm"
    elif base == "go.work":
        for m in re.finditer(r"^\s*(?:use\s+)?(\./\S+)", content, re.M):
            yield m[1], "go"
    elif base == "cargo.toml" and (m := re.search(r"\[workspace\].*?members\s*=\s*\[(.*?)\]", content, re.S)):
        for x in re.findall(r"\"([^\"]+)\"", m[1]):
            yield x, "cargo"
    elif base == "package.json" and '"workspaces"' in content:
        w = json.loads(content).get("workspaces")
        for x in (w if isinstance(w, list) else (w or {}).get("packages", [])):
            yield x, "npm"


def _trimmed(text: str) -> str:
    return text.encode("utf-8", "replace")[:CHUNK_BYTES].decode("utf-8", "ignore").strip()


def chunks(path: str, lang: str | None, content: str, lines: list[str], symbols: list[tuple]) -> Iterator[tuple]:
    """(name, first line, last line, text): one chunk for each symbol, of at most 8000 bytes, and one of the file.

    The file's chunk is there without symbols, for languages that are kept whole, and where a file of at
    most 8000 bytes and 200 lines has source outside its symbols. It has at most 8000 bytes too, but
    for manifests, which are complete."""
    covered = [False] * len(lines)
    for s in symbols:
        yield s[1], s[4], s[5], _trimmed("\n".join(lines[s[4] - 1 : s[5]]).strip())
        covered[s[4] - 1 : s[5]] = [True] * len(covered[s[4] - 1 : s[5]])
    count = content.count("\n") + 1  # as the reference counts them: a last line break starts a line
    small = len(content.encode("utf-8", "replace")) <= CHUNK_BYTES and count <= CHUNK_LINES
    if not symbols or lang in WHOLE_LANGUAGES or small and any(not c and _SOURCE.search(x) for c, x in zip(covered, lines)):
        whole = path.replace("\\", "/").rsplit("/", 1)[-1] in WHOLE_MANIFESTS
        yield "", 1, count, content.strip() if whole else _trimmed(content)


def facts_of(path: str, lang: str | None, content: str) -> Iterator[tuple]:
    """(fact, name, kind, detail, line_start, line_end, content) of one file."""
    lines = content.splitlines()
    found: list[tuple] = []
    try:
        found = list(_python(content)) if lang == "python" else list(_patterns(lang or "", lines))
    except (SyntaxError, ValueError, RecursionError) as e:
        yield "diagnostic", "parse", "degraded", str(e)[:200], 1, len(lines), ""
    for f in found:
        yield (*f, "")
    for name, a, b, text in chunks(path, lang, content, lines, [f for f in found if f[0] == "symbol"]) if content else ():
        yield "chunk", name, lang or "text", "", a, b, text
    for n, line in enumerate(lines, 1):
        for pattern, source, edge in _FLAGS:
            for m in re.finditer(pattern, line):
                yield "flag", m[1], edge, source, n, n, line.strip()[:200]
        for pattern, frame, order in _ROUTES:
            for m in re.finditer(pattern, line):
                method, url = (m[1], m[2]) if order == "first" else (m[2] or "GET", m[1])
                handler = next((h[1] for x in lines[n : n + 4] if (h := re.search(r"(?:def|function|public\s+\S+)\s+(\w+)\s*\(", x))), "")
                yield "route", url, method.upper(), f"{frame}:{handler}", n, n, line.strip()[:200]
    try:
        for name, eco, req, n, lock in dependencies(path, content):
            yield "dependency", name, eco, json.dumps({"lock": lock, "requirement": req}, sort_keys=True), n, n, ""
        for member, kind in workspaces(path, content):
            yield "workspace", member, kind, "", 1, 1, ""
    except ValueError as e:
        yield "diagnostic", "manifest", "degraded", str(e)[:200], 1, len(lines), ""
    if lang in ("json", "yaml", "toml", "properties", "ini", "xml"):
        for key, kind, value, n in config_facts(lang, lines):
            yield "config", key, kind, value[:200], n, n, ""


def extract(files: DataFrame) -> DataFrame:
    """All facts of (scope, file_id, path, content) rows."""
    from ..functions import paths as P

    rows = files.select("scope", "file_id", "path", P.language(F.col("path")).alias("lang"), F.coalesce("content", F.lit("")).alias("content"))

    def run(batches):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            out = [(r.scope, r.file_id, r.path, *f) for r in b.itertuples() for f in facts_of(r.path or "", r.lang, r.content)]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, SCHEMA)


def grep(files: DataFrame, needle: str, max_line: int = 4096) -> DataFrame:
    """(path, line, text) of lines with a fixed string; longer lines than max_line are left out as in a bounded search."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    return lines.where((F.octet_length("text") <= max_line) & F.col("text").contains(needle)).select("path", (F.col("n") + 1).alias("line"), "text")
