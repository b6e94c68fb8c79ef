"""Retrievers, fusion, rerank and context packs over evidence and facts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

RRF_K = 60
K1, B = 1.2, 0.75


def visible_at(v: int) -> Column:
    """Facts of version v; valid_until is inclusive."""
    return (F.col("created") <= v) & (F.col("valid_from") <= v) & (F.col("valid_until").isNull() | (F.col("valid_until") >= v))


def retrievable(v: int, scope: str | None = None) -> Column:
    """Evidence of version v that isn't rejected or superseded, of one scope if one is named."""
    c = (F.col("created") <= v) & F.col("status").isin("accepted", "proposed")
    return c & (F.col("source_scope") == scope) if scope else c


def candidate_limit(limit: int, rerank: bool = True) -> int:
    return min(max(limit * 4, limit + 1), max(64, limit + 1)) if rerank else limit + 1


def check_plan(query: str, limit: int) -> None:
    if not query.strip() or not 1 <= limit <= 50:
        raise ValueError("a query needs text and a limit from 1 to 50")


def fts_tokens(query: str) -> list[str]:
    return sorted(set(re.findall(r"[a-z0-9_]+", query.lower())))


def bm25_counts(docs: DataFrame, query: str, id_col: str = "evidence_id", text_col: str = "content", keep: list[Column] | None = None) -> DataFrame:
    """(id, dl, tf): a document's length and how often it has each token of the query, with any further columns to keep."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    count = lambda t: F.size(F.filter("_w", lambda x: x == t)).cast("double")
    x = docs.select(F.col(id_col), words.alias("_w"), *(keep or []))
    return x.select(id_col, F.size("_w").cast("double").alias("dl"), F.array(*map(count, fts_tokens(query))).alias("tf"), *[c for c in x.columns if c not in (id_col, "_w")])


def okapi(tf: Column) -> Column:
    """Score of term counts, given columns n, df, dl and avgdl: k1 1.2, b 0.75."""
    idf = lambda d: F.log((F.col("n") - d + 0.5) / (d + 0.5) + 1)
    part = F.zip_with(tf, "df", lambda t, d: idf(d) * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    return F.aggregate(part, F.lit(0.0), lambda a, b: a + b)


def bm25_scores(counted: DataFrame, query: str, id_col: str = "evidence_id") -> DataFrame:
    """(id, score), Okapi with k1 1.2 and b 0.75, of counts: corpus statistics are one row."""
    n = len(fts_tokens(query))
    stats = counted.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), F.array(*[F.sum(F.when(F.col("tf")[i] > 0, 1.0).otherwise(0.0)) for i in range(n)]).alias("df"))
    hits = counted.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))  # one row
    return hits.select(id_col, okapi(F.col("tf")).alias("score"))


def bm25(docs: DataFrame, query: str, id_col: str = "evidence_id", text_col: str = "content") -> DataFrame:
    """(id, score) of documents with any token of the query. Only counts leave the scan: no postings are shuffled."""
    return bm25_scores(bm25_counts(docs, query, id_col, text_col), query, id_col)


def top(hits: DataFrame, n: int, id_col: str = "evidence_id") -> DataFrame:
    return hits.orderBy(F.desc("score"), F.asc(id_col)).limit(n)


def ranked(hits: DataFrame, source: str, id_col: str = "evidence_id") -> DataFrame:
    """Ranks of one retriever's list, which is bounded by its candidate limit."""
    return hits.select(F.col(id_col).alias("key"), F.lit(source).alias("source"), F.row_number().over(Window.orderBy(F.desc("score"), F.asc(id_col))).alias("rank"), F.col("score"))


BLOCK = 16_384  # vectors of a block of a product


def _best(k: int):
    """Of a block of vectors (vec_id, v) and one of queries (q, v), each query's nearest: twice k, as rounding is Spark's."""
    import numpy as np
    import pyarrow as pa

    def unit(t: pa.Table, size: int):
        """Vectors of one length as unit rows, NaN where there is none."""
        v = t.column("v").combine_chunks()
        fits = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(v), -1)) == size
        x = np.full((len(v), size), np.nan)
        x[fits] = np.asarray(v.filter(pa.array(fits)).flatten(), dtype=float).reshape(-1, size)
        with np.errstate(invalid="ignore", divide="ignore"):
            return x, np.sqrt((x * x).sum(1))

    def of(_, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qs = left.column("vec_id").combine_chunks(), right.column("q").combine_chunks()
        out_q, out_v, out_s = [], [], []
        lengths = pa.compute.fill_null(pa.compute.list_value_length(right.column("v").combine_chunks()), -1)
        order = np.empty(len(ids), np.int64)
        order[np.asarray(pa.compute.sort_indices(ids))] = np.arange(len(ids))  # of equal scores the least id
        named = ids.dictionary_encode()
        name, own = np.asarray(named.indices), np.asarray(pa.compute.fill_null(pa.compute.index_in(qs, named.dictionary), -1))
        for size in np.unique(np.asarray(lengths)) if len(ids) else ():
            rows = np.flatnonzero(np.asarray(lengths) == size)
            (v, vn), (q, qn) = unit(left, max(size, 0)), unit(right, max(size, 0))
            for at in range(0, len(rows), 200):
                part = rows[at : at + 200]
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = (q[part] @ v.T) / (qn[part][:, None] * vn)
                rounded = np.floor(np.where(np.isnan(s), -9.0, s) * 1e9 + 0.5)
                for i, j in enumerate(part):
                    r = rounded[i]
                    if own[j] >= 0:
                        r[name == own[j]] = -np.inf
                    most = min(2 * k, len(r))
                    near = np.flatnonzero(r >= np.partition(r, len(r) - most)[len(r) - most])
                    near = near[np.lexsort((order[near], -r[near]))][:most]
                    near = near[r[near] > -np.inf]
                    out_q.append(np.full(len(near), j))
                    out_v.append(near)
                    out_s.append(s[i, near])
        at = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64))
        found = np.concatenate([np.zeros(0), *out_s])
        return pa.table({"q": qs.take(at(out_q)), "vec_id": ids.take(at(out_v)), "s": pa.array(found, mask=np.isnan(found))})

    return of


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(q, vec_id, rank, s): the k vectors of (vec_id, v) nearest by cosine to each query of the same shape, itself apart.

    Vectors and queries are dealt out in blocks, each block of the ones meets each of the others in one task, which
    multiplies them as matrices and keeps a query's best. A search against everything is that many products; memory is
    that of two blocks, and of what is shuffled, each block goes as often as the other side has blocks."""
    n, m = vectors.count(), queries.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    of_v, of_q = max(1, -(-n // block), min(cores, -(-n // 512))), max(1, -(-m // block))
    dealt = lambda df, own, c, most, other, others: df.withColumn(own, F.pmod(F.xxhash64(c), F.lit(most)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("a", "b")
    left = dealt(vectors.where("vec_id is not null").select("vec_id", F.col("v").cast("array<double>").alias("v")), "a", "vec_id", of_v, "b", of_q)
    right = dealt(queries.select(F.col("vec_id").alias("q"), F.col("v").cast("array<double>").alias("v")), "b", "q", of_q, "a", of_v)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    few = left.cogroup(right).applyInArrow(_best(k), f"q {kind}, vec_id {kind}, s double")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("s", 9)), "vec_id"))
    return few.withColumn("rank", best).where(F.col("rank") <= k).select("q", "vec_id", "rank", "s")


def wants_time(query: str) -> bool:
    q = query.lower()
    return as_of(query) is not None or bool(re.search(r"\b\d{4}\b", q)) or any(w in q for w in ("when", "timeline", "history", "temporal"))


def as_of(query: str) -> str | None:
    for t in query.split():
        for p in ("as_of:", "as-of:"):
            if t.lower().startswith(p):
                return t[len(p) :]
    return None


def wants_community(query: str) -> bool:
    return any(w in query.lower() for w in ("summary", "overview", "community", "global", "map"))


def temporal_filter(query: str) -> Column:
    cut = as_of(query)
    years = [t for t in re.findall(r"[A-Za-z0-9_]+", " ".join(w for w in query.split() if not re.match(r"(?i)as[_-]of:", w))) if re.fullmatch(r"\d{4}", t)]
    year_ok = F.lit(not years)
    for y in years:
        year_ok = year_ok | F.col("occurred_at").contains(y)
    if cut is None:
        return F.col("occurred_at").isNotNull() & year_ok
    return F.coalesce(T.date_bound(F.col("occurred_at"), False) <= T.date_bound(F.lit(cut), True), F.lit(False)) & year_ok


def fuse(lists: list[DataFrame]) -> DataFrame:
    """Reciprocal rank fusion: (key, rrf, sources). A key that a list has twice counts twice."""
    u = lists[0]
    for x in lists[1:]:
        u = u.unionByName(x)
    return u.groupBy("key").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set("source")).alias("sources"))


def rerank(hits: DataFrame, query: str) -> DataFrame:
    """rrf plus coverage of content (.40), labels (.25), facts (.20) and path (.05), .05 for each further source, .08 facts, .03 span, .04 code."""
    q = T.driver_terms(query, 1)
    cover = lambda c: T.term_coverage(q, T.terms(c, 1))
    score = F.col("rrf") + 0.40 * cover(F.col("content")) + 0.25 * cover(F.array_join("labels", " ")) + 0.20 * cover(F.array_join("facts", " ")) + 0.05 * cover(F.col("source_path")) + 0.05 * (F.size("sources") - 1) + F.when(F.size("facts") > 0, 0.08).otherwise(0.0) + F.when(F.col("has_span"), 0.03).otherwise(0.0) + F.when(F.array_contains("sources", "code_graph"), 0.04).otherwise(0.0)
    return hits.withColumn("score", score)


def byte_budget(hits: DataFrame, budget: int, order: list[Column], size: Column) -> DataFrame:
    """Hits in order while their running bytes stay within the budget; hits are a bounded candidate list."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("bytes", size.cast("long")).withColumn("running", F.sum("bytes").over(w)).where(F.col("running") <= budget)
