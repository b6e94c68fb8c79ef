"""Best-fit packing of token sequences by exact complements.

Lengths are at most ``capacity``, so the whole packing problem is a histogram of ``capacity`` counts,
however many documents there are: it is solved on the driver, in bulk, and only the counts go there.
For each length, largest first, the gap it leaves is looked up among the available single lengths,
sums of two and sums of three (a table of availability counts by length; a pair or triple is found
from its complement). A combination that fills the gap exactly is consumed as often as counts allow.
What is left is packed best-fit, in bulk as well: each remaining length,
longest first, takes the combination that leaves the least of its gap. How many pieces a complement may
have, and whether pairs are as uneven or as even as can be, decides which short pieces are left for
the residuals; each choice is worked out (always complements first, then residuals) and the one of the
fewest sequences counts. The result is a list of slots: so many
pieces of this length, ranks r0 to r1 of their kind, go to sequences from s on, at this offset.

Pieces learn their rank without a shuffle by length: each task numbers its own pieces of each length,
and running totals over tasks give the base. No length, however frequent, meets in one task.

Edge cases: null and empty texts are the end mark alone; documents of the same length are
interchangeable and ranked in the order they lie; a null id is packed like any other, and so is each
row of a repeated id. A very long text is encoded whole and cut into pieces of the capacity; an empty
table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, text_id

CAPACITY, END = 1024, 2
_encoders: dict[str, object] = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary file in the tokenizers format.

    The same vocabulary and split pattern also serve as ranks for tiktoken, which is several times as
    fast; tests compare the two. Texts that contain a special token's string go to tokenizers itself."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.path = path
        spec = json.load(open(path))
        self.slow = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in chars}
        byte |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in chars)}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(batches, path: str, capacity: int, end: int):
    encoder = _encoder(path)
    part = TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        out: list[list] = [[] for _ in range(6)]

        def rows():
            r = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out] + [pa.array([part] * len(out[0]), pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"])
            for x in out:
                x.clear()
            return r

        for i in range(batch.num_rows):
            doc = ids[i].as_py()
            tokens = np.array([*encoder.ids(texts[i].as_py() or ""), end], "<u4")
            first = len(tokens) % capacity or capacity
            edges = [0, *range(first, len(tokens) + 1, capacity)]
            for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                for x, v in zip(out, (doc, p, a, b - a, zlib.crc32(tokens[a:b].tobytes()), seen[b - a])):
                    x.append(v)
                seen[b - a] += 1
            if len(out[0]) >= 20_000:
                yield rows()
        if out[0]:
            yield rows()


def solve(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Slots (length, r0, r1, first sequence, offset) for counts[length] pieces of each length: the best of the ways."""
    ways = [_patterns(counts, capacity, parts, even) for parts in (1, 2, 3) for even in (False, True)[: parts]]
    patterns = min(ways, key=lambda w: sum(k for _, k in w))
    slots, ranks, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, k in patterns:
        at = 0
        for x in lengths:
            slots.append((x, ranks[x], ranks[x] + k, sequence, at))
            ranks[x] += k
            at += x
        sequence += k
    return np.array(sorted(slots), np.int64).reshape(-1, 5)


def _fill(left: np.ndarray, gap: int) -> list[int]:
    """Available lengths that fill the most of a gap, the longer first (subset sums under counts)."""
    last, reach = np.zeros(gap + 1, np.int64), np.zeros(gap + 1, bool)
    reach[0] = True
    for a in np.flatnonzero(left[: gap + 1])[::-1]:
        for _ in range(min(int(left[a]), gap // a)):
            new = np.zeros_like(reach)
            new[a:] = reach[:-a]
            new &= ~reach
            if not new.any():
                break
            last[new] = a
            reach |= new
        if reach[gap]:
            break
    s, out = int(np.flatnonzero(reach)[-1]), []
    while s:
        out.append(int(last[s]))
        s -= out[-1]
    return out


def _patterns(counts: np.ndarray, capacity: int, parts: int, even: bool) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences); parts: how many pieces a looked-up complement may have."""
    left = counts.astype(np.int64).copy()
    patterns: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> bool:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        k = min(int(left[x]) // c for x, c in need.items())
        if k <= 0:
            return False
        for x, c in need.items():
            left[x] -= c * k
        patterns.append((lengths, k))
        return True

    def pair(gap: int, spare: np.ndarray) -> tuple[int, int] | None:
        """Two available lengths that sum to gap."""
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = (spare[a] > 0) & (spare[gap - a] > 0) & ((a * 2 != gap) | (spare[a] > 1))
        i = np.flatnonzero(ok)
        return (int(a[i[-even]]), gap - int(a[i[-even]])) if len(i) else None

    def triple(gap: int, spare: np.ndarray) -> tuple[int, int, int] | None:
        for a in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if spare[a] > 0:
                spare[a] -= 1
                p = pair(gap - a, spare)
                spare[a] += 1
                if p:
                    return (a, *p)
        return None

    take((capacity,))
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        while left[length]:
            spare = left.copy()
            spare[length] -= 1
            if spare[gap] > 0:
                take((length, gap))
            elif parts > 1 and gap > 1 and (p := pair(gap, spare)):
                take((length, *p))
            elif parts > 2 and gap > 2 and (t := triple(gap, spare)):
                take((length, *t))
            else:
                break
    # residuals, longest first: each gap takes what fills the most of it
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            own = _fill(left, capacity - length)
            left[length] += 1
            take((length, *own))
    return patterns


def _place(batches, slots):
    table = slots.value
    key = table[:, 0] << np.int64(48) | table[:, 1]
    for b in batches:
        length, rank = np.asarray(b.column(3)), np.asarray(b.column(5))
        i = np.searchsorted(key, length << np.int64(48) | rank, "right") - 1
        yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(table[i, 3] + rank - table[i, 1]), pa.array(table[i, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece."""
    docs = text_id(df, id_col, text_col)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"]
    pieces = cut(docs.mapInArrow(partial(_pieces, path=tokenizer, capacity=capacity, end=end), ", ".join(f"{n} long" for n in names)), "pieces")
    per_task = pieces.groupBy("length", "part").agg(F.count("*").alias("c"))
    base = per_task.selectExpr("length", "part", "coalesce(sum(c) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) as base")
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("c").alias("c")).collect():  # at most ``capacity`` rows
        counts[r.length] = r.c
    slots = df.sparkSession.sparkContext.broadcast(solve(counts, capacity))
    ranked = pieces.join(base, ["length", "part"]).select(*names[:5], (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(partial(_place, slots=slots), ", ".join(f"{n} long" for n in [*names[:5], "sequence_id", "offset"]))
