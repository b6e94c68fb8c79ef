"""Text functions as Column expressions: identifier terms, signatures, overlaps, grams, hashed vectors.

All but ``token_terms``, ``term_slots`` and ``slot_vectors``, which read models use when they are built, stays inside the JVM. A ``let`` binds a costly value once for an expression that names it often.
"""

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
MAX_TERMS = 16
_ODD = re.compile("_|[0-9]|.[A-Z]")
_BOUNDARIES = [re.compile(p) for p in (r"([A-Z]+)([A-Z][^A-Z0-9 ])", r"([^A-Z0-9 ])([A-Z])", r"([^0-9 ])([0-9])", r"([0-9])([^0-9 ])")]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def camel(token: Column) -> Column:
    """Blanks between the parts of an identifier: at _, lower-upper, digit-letter and ACRONYMWord boundaries."""
    t = F.regexp_replace(token, "_", " ")
    for pattern in (r"([A-Z]+)([A-Z][^A-Z0-9 ])", r"([^A-Z0-9 ])([A-Z])", r"([^0-9 ])([0-9])", r"([0-9])([^0-9 ])"):
        t = F.regexp_replace(t, pattern, "$1 $2")
    return t


def parts(token: Column) -> Column:
    return F.filter(F.split(F.lower(camel(token)), " "), lambda p: p != "")


def acronym(p: Column) -> Column:
    """First characters of two parts or more, else null."""
    return F.when(F.size(p) >= 2, F.array_join(F.transform(p, lambda x: F.substring(x, 1, 1)), ""))


def terms(text: Column, min_len: int = 2) -> Column:
    """Distinct sorted terms: each word in lower case, its identifier parts and their acronym."""
    whole = lambda t: let(parts(t), lambda p: F.concat(F.array(F.lower(t)), p, F.array_compact(F.array(acronym(p)))))
    # a plain word is its only term; most words are
    one = lambda t: F.when(t.rlike("_|[0-9]|.[A-Z]"), whole(t)).otherwise(F.array(F.lower(t)))
    every = F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), one))
    return F.array_sort(F.array_distinct(F.filter(every, lambda t: F.length(t) >= min_len)))


def token_terms(token: str, min_len: int = 2) -> set[str]:
    """``terms`` of one word, in Python."""
    out = {token.lower()}
    if _ODD.search(token):
        s = token.replace("_", " ")
        for pattern in _BOUNDARIES:
            s = pattern.sub(r"\1 \2", s)
        p = s.lower().split()
        out |= {*p, *(["".join(x[0] for x in p)] if len(p) > 1 else [])}
    return {t for t in out if len(t) >= min_len}


def driver_terms(text: str, min_len: int = 2) -> list[str]:
    """``terms`` of a query string, on the driver."""
    return sorted(set().union(*(token_terms(t, min_len) for t in re.findall(r"\w+", text))))


def candidate_terms(query: list[str]) -> list[str]:
    """At most 16 terms, the longer and more structured first."""

    def priority(t: str) -> int:
        n = len(t)
        base = 8 if n >= 16 else 6 if n >= 12 else 4 if n >= 8 else 2 if n >= 5 else 1
        mixed = any(c.isalpha() for c in t) and any(c.isdigit() for c in t)
        return base + 8 * ("_" in t or mixed)

    return sorted(query, key=lambda t: (-priority(t), t))[:MAX_TERMS]


def lit_array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def token_signature(content: Column, labels: Column, path: Column) -> Column:
    return terms(F.concat_ws(" ", content, F.array_join(labels, " "), path))


def semantic_overlap(query: list[str], doc: Column) -> Column:
    """|Q and D| / |Q| + |Q and D| / |Q or D|."""
    both = F.size(F.array_intersect(doc, lit_array(query)))
    return both / F.lit(max(1, len(query))) + both / (F.size(doc) + len(query) - both)


def overlap_score(query: str, content: Column, labels: Column, path: Column) -> Column:
    """How many of the query's words stand in the text; if none, how many of its terms match a document term.

    A term matches a document term that equals it or, from three characters on, holds it or is held by it.
    Document terms of plain words are the words, so holding is looked up in the text itself and being held
    in the query term's substrings; only identifier-like words are taken apart."""
    raw = F.concat_ws(" ", content, F.array_join(labels, " "), F.coalesce(path, F.lit("")))
    words = query.lower().split()
    q = driver_terms(query)

    def near(h: Column) -> Column:
        tokens = F.regexp_extract_all(raw, F.lit(WORD), F.lit(0))
        odd = F.flatten(F.transform(F.filter(tokens, lambda t: t.rlike("_|[0-9]|.[A-Z]")), lambda t: let(parts(t), lambda p: F.concat(p, F.array_compact(F.array(acronym(p)))))))

        def count(d: Column, x: Column) -> Column:
            total = F.lit(0)
            for t in q:
                hit = F.array_contains(d, t) | F.array_contains(x, t)
                if len(t) >= 3:
                    subs = lit_array(sorted({t[i:j] for i in range(len(t)) for j in range(i + 3, len(t) + 1)}))
                    hit = h.contains(t) | F.arrays_overlap(d, subs) | F.arrays_overlap(x, subs) | F.exists(x, lambda e: e.contains(t))  # noqa: B023
                total = total + F.when(hit, 1).otherwise(0)
            return total

        return let(F.struct(F.transform(tokens, F.lower).alias("d"), odd.alias("x")), lambda s: count(s["d"], s["x"]))

    def score(h: Column) -> Column:
        direct = sum((F.when(h.contains(w), 1).otherwise(0) for w in words), F.lit(0))
        return let(direct, lambda n: F.when(n > 0, n).otherwise(near(h)))

    return let(F.lower(raw), score).cast("double")


def term_coverage(query: list[str], doc: Column) -> Column:
    return F.size(F.array_intersect(doc, lit_array(query))) / F.lit(max(1, len(query)))


def grams(label: Column, n: int) -> Column:
    """Distinct n-grams of the lowered, trimmed label."""
    return let(F.lower(F.trim(label)), lambda x: F.array_distinct(F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))))


def low_hash(term: Column) -> Column:
    """Low four bits of FNV-1a 64 of the term's bytes; those bits never depend on higher ones."""
    h = F.hex(F.encode(term, "UTF-8"))
    low = F.transform(F.sequence(F.lit(1), F.octet_length(term)), lambda i: F.conv(F.substring(h, i * 2, F.lit(1)), 16, 10).cast("int"))
    return F.aggregate(low, F.lit(5), lambda a, b: (a.bitwiseXOR(b).bitwiseAND(15) * 3).bitwiseAND(15))


def hashed_vector(signature: Column, dimension: int = 16) -> Column:
    """Signed feature counts of the terms, normalised; dimension 16 or a divisor of it. Sign and slot come from one hash."""
    slots = F.transform(signature, low_hash)
    raw = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(s, lambda x: x % dimension == i)).cast("double") * F.when(i % 2 == 0, 1.0).otherwise(-1.0))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, b: a + b * b))
    return let(let(slots, raw), lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))))


def term_slots(terms: list[bytes]):
    """``low_hash`` of each term: all step through their bytes together."""
    import numpy as np

    n = np.fromiter(map(len, terms), np.int64, len(terms))
    start, data = np.cumsum(n) - n, np.frombuffer(b"".join(terms) or b"\0", np.uint8)
    h = np.full(len(n), 5, np.uint8)
    own = np.argsort(-n, kind="stable")  # the longest first: those that go on are a prefix
    for i in range(int(n.max(initial=0))):
        own = own[: int(np.searchsorted(-n[own], -i))]
        h[own] = ((h[own] ^ data[start[own] + i]) & 15) * 3 & 15
    return h


def slot_vectors(slots, row, rows: int):
    """``hashed_vector`` of dimension 16 for rows, from the slot of each of their terms."""
    import numpy as np

    v = np.bincount(row * 16 + slots, minlength=16 * rows).reshape(-1, 16).astype(float)
    v[:, 1::2] *= -1
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.where(norm > 0, v / np.where(norm > 0, norm, 1), v)


def hashed_vectors(signatures: pd.Series):
    """``hashed_vector`` of dimension 16 for a batch."""
    import numpy as np

    sizes = np.array([0 if s is None else len(s) for s in signatures])
    return slot_vectors(term_slots([t.encode() for s in signatures if s is not None for t in s]), np.repeat(np.arange(len(sizes)), sizes), len(sizes))


def driver_hash(term: str) -> int:
    h = 5
    for b in term.encode():
        h = ((h ^ b) & 15) * 3 & 15
    return h


def driver_vector(query: list[str], dimension: int = 16) -> list[float]:
    v = [0.0] * dimension
    for t in query:
        i = driver_hash(t) % dimension
        v[i] += 1.0 if i % 2 == 0 else -1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n if n else x for x in v]


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, not under 0; 0 where lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(0.0), dot)).otherwise(0.0)


def query_tokens(query: str) -> list[str]:
    """The words of a query in lower case, and the identifiers in those that aren't paths."""
    return list(dict.fromkeys(x for w in query.lower().split() for x in [w, *([] if "/" in w else [p for p in re.findall(r"[a-z0-9_]+", w) if len(p) >= 2])]))


def token_points(query: str, value: Column) -> Column:
    """Each token's points in one field, an array: 4 equal, 2 an identifier term, 0.5 contained. Its terms are computed once."""
    point = lambda v, t: F.when(v["low"] == t, 4.0).when(F.array_contains(v["terms"], t), 2.0).when(v["low"].contains(t), 0.5).otherwise(0.0)
    made = F.struct(F.lower(F.coalesce(value, F.lit(""))).alias("low"), terms(value, 1).alias("terms"))
    return let(made, lambda v: F.array(*[point(v, t) for t in query_tokens(query)]).cast("array<double>"))


def sum_points(fields: list[Column]) -> Column:
    """The best field of each token, summed."""
    best = fields[0]
    for x in fields[1:]:
        best = F.zip_with(best, x, lambda a, b: F.greatest(a, b))
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + x)


def score_query(query: str, fields: list[Column]) -> Column:
    """For each token its best field: 4 equal, 2 an identifier term, 0.5 contained; summed."""
    if not query_tokens(query):
        return F.lit(0.0)
    return let(F.array(*[token_points(query, f) for f in fields]), lambda v: sum_points([v[i] for i in range(len(fields))]))


def exact_path(query: str, path: Column) -> Column:
    q = query.strip().lower()
    return F.when(F.lower(path) == q, 4.0).when(F.substring_index(F.lower(path), "/", -1) == q, 2.0).otherwise(0.0)


def partial_date(text: Column) -> Column:
    """Struct (year, month, day) of YYYY[-MM[-DD]] or YYYY/MM/DD, nulls for what isn't told; null if out of range."""
    part = lambda i: F.nullif(F.regexp_extract(F.trim(text), r"^(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2}))?)?(?:[T ].*)?$", i), F.lit("")).cast("int")
    y, m, d = part(1), part(2), part(3)
    ok = y.isNotNull() & F.coalesce(m.between(1, 12), F.lit(True)) & F.coalesce(d.between(1, 31), F.lit(True))
    return F.when(ok, F.struct(y.alias("y"), m.alias("m"), d.alias("d")))


def date_bound(text: Column, upper: bool) -> Column:
    """The first (or last) day a partial date may mean, as y * 10000 + m * 100 + d."""
    return let(partial_date(text), lambda p: p["y"] * 10000 + F.coalesce(p["m"], F.lit(12 if upper else 1)) * 100 + F.coalesce(p["d"], F.lit(31 if upper else 1)))


def basis_points(ratio: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)) * 10000).cast("int")


def truncate_label(label: Column, most: int) -> Column:
    return F.when(F.length(label) <= most, label).otherwise(F.concat(F.substring(label, 1, most - 1), F.lit("…")))


def routed_intent(query: str) -> str:
    return "direct" if len(query.split()) <= 3 else "multi_term"
