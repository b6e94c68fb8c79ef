"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

A short item inside a long document has a tiny Jaccard similarity, so signatures of whole documents
say nothing. The search is by containment instead: an item keeps its MinHash elements (for each of
``sketch`` permutations the shingle of least rank), and the share of them that a document holds
estimates how much of the item the document contains.

Items are partitioned by size, a partition for each power of two of their shingles, each with a sorted
array of its own. A partition is probed only by documents that have shingles enough to contain its
least item. Where all shingles of an item fit the sketch it is the set itself and the needed number of
hits is exact; of a larger one a quarter of the sketch must be hit, which an item contained to 80 %
fails with a probability under 1e-7. Each candidate is then verified by its shingles' own words.

Documents are never moved: they are scanned once, where they lie. Items are indexed in blocks of about
``block_bytes`` of text, built by tasks of their own as files in the shared folder, which executors map
into memory: neither the driver nor a Python worker holds an index, however many blocks there are.

Edge cases: an item or document without words, or null, has no shingles and matches nothing; one of
fewer words than a shingle has a single shingle of all its words; repeated items each match, and so do
repeated documents and null ids. Very long texts are worked on whole; without items nothing matches and
all documents are clean; an empty table gives no rows. ``drop_contaminated`` keeps extra columns of any
name, ``contained_items`` ignores them.
"""

from __future__ import annotations

import math
import os
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import _kernel as K
from ._shared import local_path, scratch, text_id

U = np.uint64
SKETCH, BLOCK_BYTES = 16, 16 << 20
_ARRAYS = ("ids", "data", "start", "end", "bounds", "values", "places", "cuts", "keys", "owner", "partitions", "need", "seen")


def _grams(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether there is one) of the shingle that starts at each word."""
    g, some = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
    every = K.grams(h, k)
    g[: len(every)] = every
    n = np.diff(bounds)
    some[:] = np.arange(len(h)) + k <= np.repeat(bounds[1:], n)
    for d in np.flatnonzero((n > 0) & (n < k)):
        a, b = bounds[d], bounds[d + 1]
        g[a] = K.shingles(h[a:b], np.array([0, b - a]), k)[0][0]
        some[a] = True
    return g, some


def index(ids: list[int | None], texts: list[str | None], k: int, percent: int, sketch: int) -> dict[str, np.ndarray]:
    """The arrays of a block of items."""
    data = [(t or "").encode() for t in texts]
    buf = K.lower(np.frombuffer(b"".join(data), np.uint8))
    start, end, bounds = K.words(buf, np.cumsum([0, *map(len, data)]))
    g, some = _grams(K.word_hashes(buf, start, end), bounds, k)
    at = np.flatnonzero(some)
    item = np.repeat(np.arange(len(ids)), np.diff(bounds))[at]
    order = np.lexsort((g[at], item))
    at, item = at[order], item[order]
    value = g[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (item[1:] != item[:-1])
    # shingles of one hash are one shingle only if their words are
    again = np.flatnonzero(~new)
    width = np.minimum(k, np.diff(bounds))[item[again]]
    for j in range(k if len(again) else 0):
        own = np.flatnonzero(width > j)
        new[again[own[~K.same_words(buf, start, end, at[again[own]] + j, at[again[own] - 1] + j)]]] = True
    at, item, value = at[new], item[new], value[new]
    cuts = np.searchsorted(item, np.arange(len(ids) + 1))
    n = np.diff(cuts)
    # sketches: all shingles of small items, of others the least under each permutation
    small = n[item] <= sketch
    taken = [np.flatnonzero(small)]
    rest = np.flatnonzero(~small)
    if len(rest):
        first = np.flatnonzero(np.append(True, item[rest][1:] != item[rest][:-1]))
        whose = np.cumsum(np.append(False, item[rest][1:] != item[rest][:-1]))
        for t in range(sketch):
            rank = K.mix(value[rest] ^ U((0x9E3779B97F4A7C15 * (t + 1)) % 2**64))
            taken.append(rest[np.flatnonzero(rank == np.minimum.reduceat(rank, first)[whose])])
    taken = np.unique(np.concatenate(taken))
    keys, owner = value[taken], item[taken]
    size = np.where(n > 0, np.log2(np.maximum(n, 1)).astype(np.int64), 0)
    order = np.lexsort((keys, size[owner]))
    keys, owner = keys[order], owner[order]
    edges = np.searchsorted(size[owner], np.arange(size.max(initial=0) + 2))
    hits = np.bincount(owner, minlength=len(ids))
    need = np.where(n <= sketch, -(-percent * n // 100), np.maximum(1, hits // 4))
    bits = min(23, max(16, int(math.log2(len(keys) + 1)) + 4))
    seen = np.zeros(1 << bits, bool)
    seen[(keys >> U(64 - bits)).astype(np.int64)] = True
    partitions = np.array([(e, a, b) for e, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a], np.int64).reshape(-1, 3)
    known = np.array([i is not None for i in ids], bool)
    plain = np.array([i or 0 for i in ids], np.int64)
    return {"ids": np.stack([plain, known.astype(np.int64)]), "data": buf, "start": start.astype(np.int32), "end": end.astype(np.int32), "bounds": bounds, "values": value, "places": at.astype(np.int32), "cuts": cuts, "keys": keys, "owner": owner.astype(np.int32), "partitions": partitions, "need": need, "seen": seen}


def _write(table: pa.Table, folder: str, k: int, percent: int, sketch: int) -> pa.Table:
    """One block, in files under a name that no other attempt has."""
    path = f"{folder}/{uuid.uuid4().hex}"
    os.makedirs(path)
    for name, a in index(table.column("i").to_pylist(), table.column("t").to_pylist(), k, percent, sketch).items():
        with open(f"{path}/{name}.npy", "wb") as f:
            np.save(f, a)
    return pa.table({"path": pa.array([path], pa.string())})


class Block:
    """A mapped block of items."""

    def __init__(self, path: str, k: int, percent: int):
        self.k, self.percent = k, percent
        for name in _ARRAYS:
            a = np.load(f"{path}/{name}.npy", mmap_mode="r") if os.path.getsize(f"{path}/{name}.npy") > 128 else np.load(f"{path}/{name}.npy")
            setattr(self, name, np.asarray(a))
        self.bits = int(math.log2(len(self.seen)))

    def candidates(self, g: np.ndarray, some: np.ndarray, doc: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) whose sketch is hit often enough; n is how many shingles a document has at most."""
        at = np.flatnonzero(some & self.seen[(g >> U(64 - self.bits)).astype(np.int64)])
        at = at[np.lexsort((g[at], doc[at]))]
        key, of = g[at], doc[at]
        new = np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])) if len(at) else np.zeros(0, bool)
        key, of = key[new], of[new]
        out = []
        for size, a, b in self.partitions:
            fit = n[of] >= -(-self.percent * (1 << int(size)) // 100)
            k, d = key[fit], of[fit]
            lo, hi = np.searchsorted(self.keys[a:b], k, "left"), np.searchsorted(self.keys[a:b], k, "right")
            k, d, lo, many = k[hi > lo], d[hi > lo], lo[hi > lo] + a, (hi - lo)[hi > lo]
            # as many documents at a time as have two million hits; one alone has at most all keys of the block
            first = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else d
            total = np.concatenate([[0], np.cumsum(many)])
            p = 0
            while p < len(first):
                q = max(p + 1, int(np.searchsorted(total[np.append(first[1:], len(d))], total[first[p]] + 2_000_000, "right")))
                rows = slice(first[p], first[q] if q < len(first) else len(d))
                m = many[rows]
                j = np.repeat(lo[rows] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                pair, hits = np.unique(np.repeat(d[rows], m) * len(self.need) + self.owner[j], return_counts=True)
                good = hits >= self.need[pair % len(self.need)]
                out += zip((pair[good] // len(self.need)).tolist(), (pair[good] % len(self.need)).tolist())
                p = q
        return sorted(out)

    def search(self, s: Slice) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of each containment that holds."""
        out, last, own, order = [], -1, None, None
        for d, i in self.candidates(s.g, s.some, s.doc, s.n):
            if d != last:
                last, at = d, np.flatnonzero(s.some[s.bounds[d] : s.bounds[d + 1]]) + s.bounds[d]
                order = at[np.argsort(s.g[at], kind="stable")]
                own = s.g[order]
            a, b = int(self.cuts[i]), int(self.cuts[i + 1])
            lo, hi = np.searchsorted(own, self.values[a:b], "left"), np.searchsorted(own, self.values[a:b], "right")
            found = np.flatnonzero(hi > lo)
            if 100 * len(found) < self.percent * (b - a):
                continue
            width = min(self.k, int(self.bounds[i + 1] - self.bounds[i]))
            shared = 0
            for f in found.tolist():
                words = self._words(self.data, self.start, self.end, int(self.places[a + f]), width)
                shared += any(self._words(s.buf, s.start, s.end, int(order[x]), width) == words for x in range(int(lo[f]), int(hi[f])))
            if 100 * shared >= self.percent * (b - a):
                out.append((d, i, shared))
        return out

    @staticmethod
    def _words(buf, start, end, at: int, width: int) -> list[bytes]:
        return [buf[a:b].tobytes() for a, b in zip(start[at : at + width], end[at : at + width])]


class Slice:
    """The words and shingles of some documents."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, k: int):
        self.buf = K.lower(buf)
        self.start, self.end, self.bounds = K.words(self.buf, offsets)
        self.g, self.some = _grams(K.word_hashes(self.buf, self.start, self.end), self.bounds, k)
        words = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(words)), words)
        self.n = np.where(words > 0, np.maximum(words - k + 1, 1), 0)


def blocks(items: DataFrame, item_id: str, item_text: str, k: int, percent: int, sketch: int, block_bytes: int) -> list[str]:
    """Writes indexes of all items, each over about block_bytes of text, to the shared folder; their paths."""
    spark = items.sparkSession
    ship(spark)
    folder = local_path(scratch(spark, "items"))
    os.makedirs(folder, exist_ok=True)
    it = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    total = it.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    block = F.pmod(F.xxhash64("i", "t"), F.lit(max(1, math.ceil(total / block_bytes))))

    def write(table: pa.Table) -> pa.Table:
        return _write(table, folder, k, percent, sketch)

    made = it.withColumn("block", block).groupBy("block").applyInArrow(write, "path string")
    return [r.path for r in made.collect()]  # a path for each block


def _pairs(batches, paths: list[str], k: int, percent: int):
    every = [Block(p, k, percent) for p in paths]
    for rb, buf, offsets in K.slices(batches, "text"):
        s = Slice(buf, offsets, k)
        for block in every:
            if rows := block.search(s):
                d, i, shared = (np.array(x) for x in zip(*rows))
                of = np.diff(block.cuts)[i]
                ids, known = block.ids[:, i]
                yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(d)), pa.array(ids, pa.int64(), mask=known == 0), pa.array(of, pa.int64()), pa.array(shared, pa.int64()), pa.array(shared / of)], ["doc_id", "item_id", "n_item", "n_shared", "containment"])


def contained_items(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, percent: int = 80, sketch: int = SKETCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): every document that holds percent of an item's shingles."""
    docs = text_id(df, id_col, text_col)
    paths = blocks(items, item_id, item_text, shingle, percent, sketch, block_bytes)
    return docs.mapInArrow(partial(_pairs, paths=paths, k=shingle, percent=percent), "doc_id long, item_id long, n_item long, n_shared long, containment double")


def _clean(batches, paths: list[str], k: int, percent: int, at: int):
    every = [Block(p, k, percent) for p in paths]
    for batch in batches:
        texts = pa.RecordBatch.from_arrays([batch.column(at), pa.array(np.arange(batch.num_rows))], ["text", "row"])
        keep = np.ones(batch.num_rows, bool)
        for rb, buf, offsets in K.slices([texts], "text"):
            row = np.asarray(rb.column(1))
            s = Slice(buf, offsets, k)
            for block in every:
                for d, _, _ in block.search(s):
                    keep[row[d]] = False
        yield batch.filter(pa.array(keep))


def drop_contaminated(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, percent: int = 80, sketch: int = SKETCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df without the documents that hold an item; all columns stay, nothing is shuffled."""
    ship(df.sparkSession)
    paths = blocks(items, item_id, item_text, shingle, percent, sketch, block_bytes)
    return df.mapInArrow(partial(_clean, paths=paths, k=shingle, percent=percent, at=df.columns.index(text_col)), df.schema)
