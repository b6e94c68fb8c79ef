"""Removal of word sequences that an earlier document has: prefix-partitioned suffix trees.

A window of ``window`` words is removed if a document of smaller id has the same words in a row.
The suffixes that start at windows are split among trees by a prefix of variable length:

* Each suffix's prefix reaches from its first word to the end of its anchor, the least hashed
  ``gram``-word run among its first ``window`` words: ``gram`` to ``window`` words, whatever follows.
  Equal windows have equal prefixes. Prefixes that end in the same anchor make one group, so that the
  suffixes of neighbouring words mostly go together, as one run of words and not as one record each.
  An anchor that only one document has prunes all its suffixes before any text is moved.
* Where the words under an anchor stay within ``group_bytes`` they fit in memory: their suffix tree is
  built in array form, by prefix doubling (sorted suffixes, and the depth of the node where neighbours
  part). Subtrees below nodes of ``window`` words or more, over several documents, are repeats; the
  least document of each keeps its words. ``maximal_repeats`` names them: the longest spans that can't
  be extended.
* Under a more frequent anchor the prefixes are lengthened to all ``window`` words. Such a prefix leads
  to a single node, whose least document comes from a pre-aggregated min, whatever its size.

Equality is that of the words' bytes: in a tree words are numbered by their bytes (hashes only sort
them), whole windows and whole documents go by 128 bits of a cryptographic digest.

Documents with the same words throughout are one document in all of this; all but the least are removed whole.

Edge cases: null or empty text has no words; fewer words than a window: nothing is removed; words
within one document may repeat; rows with a null id are returned untouched; rows with equal ids never
remove from one another, and are told apart by their words where others remove from them. A very long
text is worked on whole; an empty table gives no rows; extra columns of any name are ignored, or kept
by ``cut_repeats``.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._shared import cut, text_id

U = np.uint64
GRAM, WINDOW, GROUP_BYTES = 10, 50, 8 << 20


def _rightmost_min(v: np.ndarray, span: int) -> np.ndarray:
    """For each start, where the least of the next ``span`` values is, the last of them on ties."""
    n = len(v) - span + 1
    at = np.arange(len(v))
    step = 1
    while step * 2 <= span:
        a, b = at[: len(at) - step], at[step:]
        at = np.where(v[b] <= v[a], b, a)
        step *= 2
    a, b = at[:n], at[span - step : span - step + n]
    return np.where(v[b] <= v[a], b, a)


def _runs(h: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """(text, first window, one after the last, anchor hash) of each run of windows that choose one anchor."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, np.zeros(0, np.uint64)
    g = K.grams(h, gram)
    anchor = g[_rightmost_min(g, window - gram + 1)]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchor)]
    good = np.arange(len(anchor)) + window <= bounds[1:][doc]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & good)
    stop = np.flatnonzero(good & np.append(new[1:] | ~good[1:], True)) + 1
    return doc[first], first, stop, anchor[first]


def _row(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _anchors(batches, window: int, gram: int):
    """Each row's digest, and its anchors with the bytes that stand under them."""
    for rb, buf, offsets in K.slices(batches, "text"):
        start, end, bounds = K.words(buf, offsets)
        doc, first, stop, anchor = _runs(K.word_hashes(buf, start, end), bounds, window, gram)
        size = end[stop + window - 2] - start[first] if len(first) else first
        order = np.lexsort((anchor, doc))
        doc, anchor, size = doc[order], anchor[order], size[order]
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]))) if len(doc) else doc
        cuts = np.searchsorted(doc[new], np.arange(len(bounds))).astype(np.int32)
        total = np.add.reduceat(size, new) if len(new) else size
        pairs = pa.StructArray.from_arrays([pa.array(anchor[new].view(np.int64)), pa.array(total)], ["anchor", "size"])
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(np.diff(bounds)), pa.array(K.digests(buf, start, end, bounds), pa.binary()), pa.ListArray.from_arrays(pa.array(cuts), pairs)], ["doc_id", "n_words", "digest", "anchors"])


def _contexts(batches, window: int, gram: int):
    """The words of each run of windows whose anchor is wanted."""
    for rb, buf, offsets in K.slices(batches, "text"):
        start, end, bounds = K.words(buf, offsets)
        doc, first, stop, anchor = _runs(K.word_hashes(buf, start, end), bounds, window, gram)
        cuts = np.searchsorted(doc, np.arange(len(offsets)))
        view = memoryview(buf)
        out: list[list] = [[], [], [], [], []]
        for d in range(len(offsets) - 1):
            own = slice(cuts[d], cuts[d + 1])
            wanted = np.array(rb.column(2)[d].as_py(), np.int64).view(np.uint64)
            runs = np.flatnonzero(np.isin(anchor[own], wanted)) + cuts[d]
            if not len(runs):
                continue
            row = _row(K.digests(buf, start, end, bounds[d : d + 2])[0])
            lo, hi = start[first[runs]].tolist(), end[stop[runs] + window - 2].tolist()
            out[0] += anchor[runs].view(np.int64).tolist()
            out[1] += [rb.column(0)[d].as_py()] * len(runs)
            out[2] += [row] * len(runs)
            out[3] += (first[runs] - bounds[d]).tolist()
            out[4] += [b" ".join(bytes(view[a:b]).split()) for a, b in zip(lo, hi)]
        if out[0]:
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary())], ["anchor", "doc_id", "row", "first", "words"])


def _windows_of(bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, place among all words) of every window of some contexts."""
    n = np.maximum(np.diff(bounds) - window + 1, 0)
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) + np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


def _window_keys(batches, window: int):
    """A digest of all its words for each window of a context of a hot anchor."""
    for rb, buf, offsets in K.slices(batches, "words"):
        start, end, bounds = K.words(buf, offsets)
        own, at = _windows_of(bounds, window)
        view = memoryview(buf)
        keys = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start[at].tolist(), end[at + window - 1].tolist())]
        take = pa.array(own)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), rb.column(1).take(take), rb.column(2).take(take), pa.array(np.asarray(rb.column(3))[own] + at - bounds[:-1][own])], ["key", "doc_id", "row", "first"])


def suffix_tree(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, depth): all suffixes of some word sequences, sorted, and at which depth each parts from the one before it.

    That is their suffix tree in array form: each maximal stretch of neighbours that part below a depth
    of d words or more is the subtree under a node of that depth. No suffix goes on into the next sequence."""
    n = len(ids)
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)  # words left in the sequence
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1]  # 0 is the end
    step = 1
    longest = int(room.max(initial=0))
    while step < longest and int(ranks[-1].max(initial=0)) < n:
        next_ = np.zeros(n, np.int64)
        on = np.flatnonzero(room > step)
        next_[on] = ranks[-1][on + step]
        ranks.append(np.unique(ranks[-1] * (n + 1) + next_, return_inverse=True)[1].astype(np.int64) + 1)
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    depth = np.zeros(n, np.int64)
    x, y = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero((room[order[:-1]] > depth[1:]) & (room[order[1:]] > depth[1:]))
        same = inside[ranks[level][x[inside]] == ranks[level][y[inside]]]
        # equal ranks are equal words up to the level's length, or up to the end of both
        on = np.minimum(1 << level, room[x[same]])
        depth[same + 1] += on
        x[same] = np.minimum(x[same] + on, n - 1)
        y[same] = np.minimum(y[same] + on, n - 1)
    return order, depth


def _trees(batches, window: int, group_bytes: int):
    """Windows that a smaller document has, as (doc_id, row, first, n) runs. Rows come sorted by anchor."""

    def grown(group: list[pa.RecordBatch]):
        table = pa.Table.from_batches(group).combine_chunks()
        for rb, buf, offsets in K.slices(table.to_batches(), "words", 1 << 40):
            start, end, bounds = K.words(buf, offsets)
            order, depth = suffix_tree(K.word_ids(buf, start, end), bounds)
            node = np.empty(len(order), np.int64)
            node[order] = np.cumsum(depth < window)  # subtrees of nodes at the window's depth
            own, at = _windows_of(bounds, window)
            doc = np.asarray(rb.column(1))[own]
            least = np.full(len(order) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, node[at], doc)
            late = np.flatnonzero(doc > least[node[at]])
            if not len(late):
                continue
            own = own[late]
            first = np.asarray(rb.column(3))[own] + at[late] - bounds[:-1][own]
            new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (first[1:] != first[:-1] + 1)))
            take = pa.array(own[new])
            yield pa.RecordBatch.from_arrays([rb.column(1).take(take), rb.column(2).take(take), pa.array(first[new]), pa.array(np.diff(np.append(new, len(own))))], ["doc_id", "row", "first", "n"])

    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for rb in batches:
        if not rb.num_rows:
            continue
        key = np.asarray(rb.column(0))
        edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        if last is not None and key[0] == last:
            edges = edges[1:]
        lo = 0
        for e in edges:  # a tree may end here
            if e > lo:
                held.append(rb.slice(lo, e - lo))
                size += held[-1].nbytes
                lo = e
            if size > group_bytes // 2:
                yield from grown(held)
                held, size = [], 0
        held.append(rb.slice(lo))
        size += held[-1].nbytes
        last = key[-1]
    if held:
        yield from grown(held)


_RUN = "doc_id long, row long, first long, n long"


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, text): (doc_id, row, first, n) runs of windows to remove, and (doc_id, digest) of whole copies to remove."""
    found = cut(docs.mapInArrow(partial(_anchors, window=window, gram=gram), "doc_id long, n_words long, digest binary, anchors array<struct<anchor:long,size:long>>"), "anchors")
    long = found.where(f"doc_id is not null and n_words >= {window}")
    least = long.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    copies = long.select("doc_id", "digest").join(least.where("least <> most").select("digest", "least"), "digest").where("doc_id <> least")
    copies = copies.select("doc_id", "digest").distinct()
    reps = long.join(least.select(F.col("least").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    spots = reps.select("doc_id", F.inline("anchors"))
    shared = spots.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("size").alias("size")).where("lo <> hi").select("anchor", "size")
    wanted = spots.select("doc_id", "anchor").join(shared.select("anchor"), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("some"))
    with_text = docs.join(wanted, "doc_id").select("doc_id", "text", "some")
    runs = cut(with_text.mapInArrow(partial(_contexts, window=window, gram=gram), "anchor long, doc_id long, row long, first long, words binary"), "contexts")
    hot = shared.where(F.col("size") > group_bytes).select("anchor")
    cold = runs.join(hot, "anchor", "left_anti")
    late = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(partial(_trees, window=window, group_bytes=group_bytes), _RUN)
    keys = runs.join(hot, "anchor", "left_semi").mapInArrow(partial(_window_keys, window=window), "key binary, doc_id long, row long, first long")
    firsts = keys.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("key", "lo")
    many = keys.join(firsts, "key").where("doc_id > lo").select("doc_id", "row", "first", F.lit(1).cast("long").alias("n"))
    return late.union(many), copies


def _marks(docs: DataFrame, window: int, gram: int, group_bytes: int) -> DataFrame:
    """(doc_id, marks): what is to be removed from the rows of an id. A first of -1 stands for all words."""
    runs, copies = repeated_windows(docs, window, min(gram, window), group_bytes)
    whole = copies.mapInArrow(_whole, _RUN)
    return runs.union(whole).groupBy("doc_id").agg(F.collect_set(F.struct("row", "first", "n")).alias("marks"))


def _whole(batches):
    for b in batches:
        if b.num_rows:
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_row(x) for x in b.column(1).to_pylist()], pa.int64()), pa.array([-1] * k, pa.int64()), pa.array([0] * k, pa.int64())], ["doc_id", "row", "first", "n"])


def _gone(buf, start, end, bounds, d: int, marks, window: int) -> np.ndarray | None:
    """Which words of a text are removed; None where none is."""
    n = int(bounds[d + 1] - bounds[d])
    if not n or not marks.is_valid:
        return None
    row = _row(K.digests(buf, start, end, bounds[d : d + 2])[0])
    edges = np.zeros(n + 1, np.int32)
    for m in marks.as_py():
        if m["row"] != row:
            continue
        if m["first"] < 0:
            return np.ones(n, bool)
        edges[m["first"]] += 1
        edges[min(m["first"] + m["n"] + window - 1, n)] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    return gone if gone.any() else None


def _apply(batches, window: int):
    for rb, buf, offsets in K.slices(batches, "text"):
        start, end, bounds = K.words(buf, offsets)
        removed, digests = [], []
        for d in range(len(offsets) - 1):
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            gone = _gone(buf, start, end, bounds, d, rb.column(2)[d], window)
            pieces = _pieces(start[lo:hi], end[lo:hi], gone)
            removed.append(0 if gone is None else int(gone.sum()))
            digests.append(hashlib.sha256(b" ".join(w for a, b in pieces for w in buf[a:b].tobytes().split())).hexdigest())
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _pieces(start, end, gone) -> list[tuple[int, int]]:
    """Byte spans of the runs of words that are kept."""
    if not len(start):
        return []
    if gone is None:
        return [(int(start[0]), int(end[-1]))]
    edge = np.diff(np.concatenate([[0], ~gone, [0]]).astype(np.int8))
    return [(int(start[a]), int(end[b - 1])) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _cut_text(buf, offsets, d, start, end, gone) -> str:
    """The text without its removed words and the space after each run of them."""
    text = buf[offsets[d] : offsets[d + 1]]
    keep = np.ones(len(text), bool)
    edge = np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        keep[start[a] - offsets[d] : (start[b] if b < len(start) else end[-1]) - offsets[d]] = False
    return text[keep].tobytes().decode("utf-8", "replace").rstrip(" ")


def _cut(batches, at: int, window: int):
    """Whole rows, the last column their marks; only texts that lose words are written anew."""
    for batch in batches:
        marks, names = batch.column(batch.num_columns - 1), batch.schema.names[:-1]
        texts = pa.RecordBatch.from_arrays([batch.column(at), marks, pa.array(np.arange(batch.num_rows))], ["text", "marks", "row"])
        new: dict[int, str] = {}
        for rb, buf, offsets in K.slices([texts], "text"):
            start, end, bounds = K.words(buf, offsets)
            for d in range(rb.num_rows):
                gone = _gone(buf, start, end, bounds, d, rb.column(1)[d], window)
                if gone is not None:
                    lo, hi = bounds[d], bounds[d + 1]
                    new[rb.column(2)[d].as_py()] = _cut_text(buf, offsets, d, start[lo:hi], end[lo:hi], gone)
        columns = list(batch.columns[:-1])
        if new:
            where = np.zeros(batch.num_rows, bool)
            where[list(new)] = True
            columns[at] = pa.compute.replace_with_mask(columns[at], pa.array(where), pa.array([new[i] for i in sorted(new)], columns[at].type))
        yield pa.RecordBatch.from_arrays([*columns, pa.array([i in new for i in range(batch.num_rows)])], [*names, "cut"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of df."""
    docs = text_id(df, id_col, text_col)
    marks = _marks(docs, window, gram, group_bytes)
    return docs.join(marks, "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(partial(_apply, window=window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group_bytes: int = GROUP_BYTES, chars_col: str | None = None) -> DataFrame:
    """df with the repeats cut out of its texts; ``chars_col``, if named, follows the text. All rows and columns stay."""
    marks = _marks(text_id(df, id_col, text_col), window, gram, group_bytes)
    # inner names, so that no column of df can clash
    names = [f"c{i}" for i in range(len(df.columns))]
    at, key = df.columns.index(text_col), names[df.columns.index(id_col)]
    inner = df.toDF(*names)
    joined = inner.join(marks.select(F.col("doc_id").alias("marked"), "marks"), F.col(key).cast("long") == F.col("marked"), "left").select(*names, "marks")
    fields = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema)]
    out = joined.mapInArrow(partial(_cut, at=at, window=window), ", ".join([*fields, "cut boolean"]))
    if chars_col in df.columns:
        n = names[df.columns.index(chars_col)]
        out = out.withColumn(n, F.when(F.col("cut"), F.length(names[at]).cast(df.schema[chars_col].dataType)).otherwise(F.col(n)))
    return out.select(*names).toDF(*df.columns)


def maximal_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, first, n_words): the longest spans of a document that earlier ones have, window by window.

    Every window of a span is repeated, and the one before it and the one after it are not. Whole copies
    are one span each."""
    docs = text_id(df, id_col, text_col)
    marks = _marks(docs, window, gram, group_bytes)
    return docs.join(marks, "doc_id").select("doc_id", "text", "marks").mapInArrow(partial(_spans, window=window), "doc_id long, first long, n_words long")


def _spans(batches, window: int):
    for rb, buf, offsets in K.slices(batches, "text"):
        start, end, bounds = K.words(buf, offsets)
        out: list[list] = [[], [], []]
        for d in range(len(offsets) - 1):
            n = int(bounds[d + 1] - bounds[d])
            row = _row(K.digests(buf, start, end, bounds[d : d + 2])[0]) if n else 0
            hit = np.zeros(max(n - window + 2, 0), bool)
            for m in rb.column(2)[d].as_py():
                if m["row"] == row and n >= window:
                    hit[slice(0, -1) if m["first"] < 0 else slice(m["first"], m["first"] + m["n"])] = True
            edge = np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                out[0].append(rb.column(0)[d].as_py())
                out[1].append(a)
                out[2].append(b - a + window - 1)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "first", "n_words"])
