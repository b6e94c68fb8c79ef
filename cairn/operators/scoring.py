"""Additive bonuses of code search: what a path is for, how an import is written, how near terms stand.

All are Column expressions; what depends on the question alone is settled on the driver. A bonus counts
only for rows that score above zero without it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T

TEST = ("testing", "bench", *(w + s for w in ("benchmark", "test") for s in ("", "s")))
EXAMPLE = tuple(w + s for w in ("sample", "example", "tutorial", "quickstart", "demo") for s in ("", "s"))
ADAPTER = ("ffi", "jni", "api", "interop", "bridge", *(w + s for w in ("wrapper", "binding", "adapter") for s in ("", "s")))
SURFACES = ("__init__.py", "mod.rs", "lib.rs", "index.js", "index.jsx", "index.ts", "index.tsx")
HEADERS = r"\.(h|hh|hpp|hxx|inc)$"
NEAR_LINES, NEAR_MOST, NEAR_BASE, NEAR_TERMS = 6, 80, 6.0, 5


def role_pattern(words: tuple[str, ...]) -> str:
    """A run of letters, anywhere in a lower-case path, that is one of the words."""
    return "(^|[^a-z])(" + "|".join(words) + ")([^a-z]|$)"


def has_role(path: Column, words: tuple[str, ...]) -> Column:
    return F.lower(path).rlike(role_pattern(words))


def asks_for(query: str, words: tuple[str, ...]) -> bool:
    """Whether an identifier of the question has one of the words as a part."""
    spaced = re.sub(r"([a-z])([A-Z])|([A-Z])(?=[A-Z][a-z])", lambda m: (m[1] or m[3]) + " " + (m[2] or ""), query)
    return any(p.lower() in words for p in re.findall(r"[A-Za-z]+", spaced))


def when_scored(base: Column, *bonuses: Column) -> Column:
    return F.when(base > 0, base + sum(bonuses, F.lit(0.0))).otherwise(base)


def _if(c: Column, x: float) -> Column:
    return F.when(c, F.lit(x)).otherwise(F.lit(0.0))


def reference_paths(path: Column, query: str) -> Column:
    """Sources before tests, unless tests are asked for."""
    if asks_for(query, TEST):
        return F.lit(0.0)
    return F.when(has_role(path, TEST), -1.25).otherwise(0.2)


def call_paths(path: Column, query: str, callers: bool) -> Column:
    """Sources before tests, examples and, among callers, adapters, unless those are asked for."""
    tests, examples, adapters = (asks_for(query, w) for w in (TEST, EXAMPLE, ADAPTER))
    out = F.lit(0.0)
    if not tests:
        plain = ~has_role(path, TEST)
        if not examples:
            plain = plain & ~has_role(path, EXAMPLE)
        if callers and not adapters:
            plain = plain & ~(has_role(path, ADAPTER) | F.lower(P.basename(path)).rlike(r"^c(\.[^.]*)?$"))
        out = out + _if(plain, 0.2) + _if(has_role(path, TEST), -0.75)
    if not examples:
        out = out + _if(has_role(path, EXAMPLE), -0.6)
    return out


def symbol_paths(path: Column, kind: Column, query: str, query_kind: str) -> Column:
    """Tests go down unless asked for; in mixed searches declarations in headers go up."""
    out = F.lit(0.0) if asks_for(query, TEST) else _if(has_role(path, TEST), -0.75)
    if query_kind == "hybrid":
        out = out + _if((kind == "function_declaration") & ~has_role(path, TEST) & F.lower(path).rlike(HEADERS), 0.55)
    return out


def is_import_path(query: str) -> bool:
    q = query.strip()
    return "/" in q or "\\" in q or any(re.search(r"[^.]\.(c|cc|cpp|cxx|h|hh|hpp|hxx|js|jsx|ts|tsx|mjs|py|rs|go|java|kt|rb|php|cs|swift|json|css|vue)$", w.strip("\"'`,;()<>")) for w in q.split())


def import_shape(path: Column, module: Column, line: Column, query: str, query_kind: str) -> Column:
    """Package surfaces go up in mixed searches; where an import path is asked for, early lines and ``from`` forms go up, a file's own implementation down."""
    out = F.lit(0.0) if asks_for(query, TEST) else _if(has_role(path, TEST), -1.25)
    if query_kind == "hybrid":
        tested = path.rlike(r"(^|/)(test|tests|__tests__)(/|$)")
        return out + _if(~tested & P.basename(path).isin(*SURFACES), 0.2)
    if is_import_path(query):
        q = query.strip()
        weight = 5.25 if q.startswith(("./", "../")) and not re.search(r"\w\.\w+$", q) else 1.0
        out = out + F.lit(weight) / F.least(F.greatest(line, F.lit(1)), F.lit(1000))
        out = out + _if(F.ltrim(module).startswith("import ") & module.contains(" from "), 0.25)
        stem = re.split(r"[/\\]", q.strip("\"'`<> "))[-1].rsplit(".", 1)[0].lower()
        own = F.regexp_replace(F.lower(P.basename(path)), r"\.[^.]*$", "") == stem
        out = out + _if(own & path.rlike(r"\.(c|cc|cpp|cxx|m|mm)$"), -0.8)
    return out


def near_terms(query: str) -> list[str]:
    """Meaningful terms of a question: identifiers, their parts, three letters or more."""
    out: set[str] = set()
    for t in re.findall(r"[A-Za-z0-9_]+", query):
        camel = re.sub(r"([A-Za-z0-9_])([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", t))
        out |= {t.lower(), *t.lower().split("_"), *camel.lower().split()}
    return sorted(t for t in out if len(t) >= 3 and t not in ("the", "and", "for", "with", "from"))


def proximity(base: Column, content: Column, path: Column, query: str) -> Column:
    """0.45 to 1.9 where most terms of a longer question stand within six lines of a short text."""
    q = near_terms(query)
    identities = sum("." in w or "::" in w or bool(re.search(r"[a-z][A-Z]", w)) for w in (x.strip("\"'`,;()<>") for x in query.split()))
    if len(q) < NEAR_TERMS or identities >= 3:
        return F.lit(0.0)
    need = max(NEAR_TERMS, -(-len(q) * 3 // 4))
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")

    def terms(line: Column) -> Column:
        def of(t: Column) -> Column:
            camel = F.regexp_replace(F.regexp_replace(t, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Za-z0-9_])([A-Z][a-z])", "$1 $2")
            return F.concat(F.array(F.lower(t)), F.split(F.lower(t), "_"), F.split(F.lower(camel), " "))

        return F.filter(F.flatten(F.transform(F.regexp_extract_all(line, F.lit("[A-Za-z0-9_]+"), F.lit(0)), of)), lambda x: x != "")

    def mask(found: Column) -> Column:
        out = F.lit(0).cast("long")
        for i, t in enumerate(q):
            alike = lambda x: (x == t) | ((F.length(x) >= 4) & (x.startswith(t) | F.lit(t).startswith(x))) if len(t) >= 4 else x == t  # noqa: B023, E731
            out = out + F.when(F.exists(found, alike), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        return out

    masks = F.transform(F.filter(lines, lambda x: x.rlike("[A-Za-z0-9_]")), lambda x: T.let(terms(x), mask))
    best = T.let(masks, lambda m: F.array_max(F.transform(m, lambda _, i: F.bit_count(F.aggregate(F.slice(m, i + 1, NEAR_LINES), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))))))
    ok = (base >= NEAR_BASE) & (F.size(lines) <= NEAR_MOST)
    if not asks_for(query, TEST):
        ok = ok & ~path.rlike(r"(?i)(^|/)(test|tests|__tests__|testing|bench|benchmark|benchmarks)(/|$)") & ~path.rlike(r"(?i)(_test|\.test\.tsx?|\.spec\.tsx?)(/|$)")
    points = T.let(F.coalesce(best, F.lit(0)), lambda n: F.when(n >= need, F.least(F.lit(1.9), 0.45 + n / len(q) * 1.45)).otherwise(0.0))
    return F.when(ok, points).otherwise(0.0)
