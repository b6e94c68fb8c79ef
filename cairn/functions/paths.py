"""Paths, modules, urls and file roles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "json": "json", "yaml": "yaml", "yml": "yaml", "properties": "properties", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "php": "php", "swift": "swift", "sql": "sql", "rb": "ruby", "sh": "bash", "bash": "bash", "md": "markdown", "toml": "toml", "xml": "xml", "ini": "ini"}
MANIFESTS = ["cargo.toml", "cargo.lock", "package.json", "package-lock.json", "pnpm-lock.yaml", "pyproject.toml", "requirements.txt", "go.mod", "go.sum", "pom.xml", "build.gradle", "conanfile.txt"]
BUILDS = ["makefile", "cmakelists.txt", "build.rs", "setup.py", "gradlew"]
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    b = basename(path)
    return F.when(F.instr(b, ".") > 0, F.lower(F.substring_index(b, ".", -1)))


def language(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for ext, lang in LANGUAGES.items():
        out = F.when(extension(path) == ext, lang).otherwise(out)
    return out


def normal_filter(f: str) -> str:
    f = f.strip().rstrip("/")
    while f.startswith("./"):
        f = f[2:]
    return f


def matches_filter(path: Column, f: str) -> Column:
    """The path is f or lies under it; . is everything."""
    f = normal_filter(f)
    return F.lit(True) if f in ("", ".") else (path == f) | path.startswith(f + "/")


def any_filter(path: Column, filters: list[str]) -> Column:
    out = F.lit(not filters)
    for f in filters:
        out = out | matches_filter(path, f)
    return out


def language_allows(path: Column, lang: Column, filters: list[str]) -> Column:
    """Languages by name; cpp admits C headers too."""
    if not filters:
        return F.lit(True)
    out = lang.isin(filters)
    return out | ((lang == "c") & path.endswith(".h")) if "cpp" in filters else out


def is_generated(path: Column, content: Column) -> Column:
    """By path (suffixes, dist or build at the top, generated or target folders) or a marker in the first 8 KiB."""
    p = F.lower(path)
    return p.rlike(r"(\.min\.js|\.pb\.go|_pb2\.py|\.g\.dart|\.generated\.[a-z]+|\.lock)$") | p.rlike(r"^(dist|build)/") | p.rlike(r"(^|/)(target|generated)/") | F.lower(F.substring(F.coalesce(content, F.lit("")), 1, 8192)).rlike(r"@generated|do not edit|auto-?generated")


def file_role(path: Column) -> Column:
    """The first that fits of: knowledge map, documentation, manifests, deployment, test, template, configuration, source."""
    p, b = F.lower(path), basename(F.lower(path))
    return (
        F.when(b.rlike(r"^knowledge[-_]?map\."), "knowledge_map")
        .when(p.rlike(r"\.(md|rst|adoc)$") | p.rlike(r"(^|/)docs?/"), "documentation")
        .when(b.isin(MANIFESTS), "dependency_manifest")
        .when(b.isin(BUILDS) | p.endswith(".cmake"), "build_manifest")
        .when(b.rlike(r"^(dockerfile|docker-compose)") | p.rlike(r"\.(tf|service)$") | p.rlike(r"(^|/)(k8s|helm|deploy)/"), "deployment")
        .when(p.rlike(r"(^|/)tests?/|_test\.[a-z]+$|\.test\.[a-z]+$|(^|/)test_[^/]*$"), "test")
        .when(p.rlike(r"\.(tmpl|tpl|j2|hbs)$"), "template")
        .when(p.rlike(r"\.(json|yaml|yml|toml|ini|properties|xml|env)$"), "configuration")
        .otherwise("source")
    )


def module_keys(path: Column) -> Column:
    """The path's stem as a::b and a.b, with crate:: before it, and the same without a leading src."""
    stem = F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")
    bare = F.regexp_replace(stem, "^src/", "")
    each = [F.regexp_replace(stem, "/", "::"), F.regexp_replace(stem, "/", "."), F.regexp_replace(bare, "/", "::"), F.regexp_replace(bare, "/", "."), F.concat(F.lit("crate::"), F.regexp_replace(bare, "/", "::"))]
    return F.array_sort(F.array_distinct(F.array(*each)))


def is_relative_module(module: Column) -> Column:
    return module.rlike(r"^(\.|crate::|self::|super::)")


def module_contains(imported: Column, changed: Column) -> Column:
    """changed stands in imported, bounded by separators or the ends."""
    norm = lambda m: F.concat(F.lit("."), F.regexp_replace(m, r"::|/|\.", "."), F.lit("."))
    return F.contains(norm(imported), norm(changed))


def url_matches(pattern: Column, url: Column) -> Column:
    """Segment by segment, :p {p} <p> fit anything; the same number of segments and at least one parameter."""
    segments = lambda u: F.split(F.regexp_replace(u, "^/+|/+$", ""), "/")
    is_param = lambda s: s.rlike(r"^(:.+|\{.+\}|<.+>)$")
    a, b = segments(pattern), segments(url)
    ok = F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(is_param(x) | (x == y), F.lit(False))), lambda x: x)
    return (F.size(a) == F.size(b)) & F.exists(a, is_param) & ok


def http_method(token: Column) -> Column:
    return F.when(F.upper(token).isin(METHODS), F.upper(token))
