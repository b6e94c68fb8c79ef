"""Columnar text kernels: words, word hashes and shingles of an Arrow string column, in numpy.

A word is a maximal run of bytes outside space and \\t..\\r. All kernels work on the UTF-8 buffer
of a slice of rows, so that Python never loops over words. Slices are bounded in bytes; a single
text larger than that is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 4 << 20
_LANES = 64  # bytes of a word that are hashed here, eight at a time

U = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(0x5EED)
_MIX = _rng.integers(1, 2**64 - 1, 64, dtype=np.uint64) | U(1)
_BASE = U(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (MurmurHash3's), on unsigned arrays."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def slices(batches, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, buffer, offsets) for slices of about ``most`` bytes of text; a null text is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        col = col.cast(pa.large_string()).cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = col.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
            hi = min(hi, len(col))
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def words(buf: np.ndarray, offsets: np.ndarray, delimiters: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    ws = delimiters[buf]
    before, after = np.empty_like(ws), np.empty_like(ws)
    before[0] = after[-1] = True
    before[1:], after[:-1] = ws[:-1], ws[1:]
    before[offsets[:-1][offsets[:-1] < len(buf)]] = True
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = True
    np.logical_not(ws, out=ws)
    start, end = np.flatnonzero(ws & before), np.flatnonzero(ws & after) + 1
    return start, end, np.searchsorted(start, offsets)


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[buf]


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one little-endian number (zeros follow the end)."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands.

    The state is mixed after each eight bytes, so no algebra of the text cancels out (a sum of powers
    would collide on words built for that); words of more than ``_LANES`` bytes go to xxh3. Words of up
    to eight bytes never collide with each other. Where a collision would change a result, the caller
    confirms with ``word_ids`` or ``same_words``."""
    n = end - start
    out = n.astype(np.uint64) * _BASE
    lanes = _lanes(buf)
    todo = np.flatnonzero(n <= _LANES)
    at, left = start[todo], n[todo]
    while len(todo):
        out[todo] = mix(out[todo] ^ (lanes[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(n > _LANES)
    if len(long):
        view = memoryview(np.ascontiguousarray(buf))
        out[long] = [xxhash.xxh3_64_intdigest(view[a:b], 0x5EED) for a, b in zip(start[long].tolist(), end[long].tolist())]
    return out


def same_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j are the same bytes, pair by pair."""
    n = end[i] - start[i]
    same = n == end[j] - start[j]
    lanes = _lanes(buf)
    todo = np.flatnonzero(same & (n <= _LANES))
    x, y, left = start[i[todo]], start[j[todo]], n[todo]
    while len(todo):
        ok = (lanes[x] ^ lanes[y]) & _MASK[np.minimum(left, 8)] == 0
        same[todo[~ok]] = False
        more = ok & (left > 8)
        todo, x, y, left = todo[more], x[more] + 8, y[more] + 8, left[more] - 8
    for t in np.flatnonzero(same & (n > _LANES)):
        same[t] = np.array_equal(buf[start[i[t]] : end[i[t]]], buf[start[j[t]] : end[j[t]]])
    return same


def word_ids(buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
    """Numbers that are equal exactly where words are: grouped by hash, then confirmed on their bytes."""
    h = word_hashes(buf, start, end) if h is None else h
    first, ids = np.unique(h, return_index=True, return_inverse=True)[1:]
    odd = np.flatnonzero(~same_words(buf, start, end, np.arange(len(h)), first[ids]))
    names: dict[bytes, int] = {}
    for i in odd:  # collisions: rare, and told apart by their bytes
        ids[i] = len(first) + names.setdefault(buf[start[i] : end[i]].tobytes(), len(names))
    return ids


def digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits of SHA-256 of each text's words, joined by one space."""
    view = memoryview(np.ascontiguousarray(buf))
    return [hashlib.sha256(b" ".join(bytes(view[start[a] : end[b - 1]]).split())).digest()[:16] if b > a else b"" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 have none. Crosses texts: the caller masks."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _MIX[0]
    for j in range(1, k):
        out += h[j : n + j] * _MIX[j]
    return mix(out)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, concatenated, and their bounds.

    A text of fewer than k words, but one at least, has one shingle: all of its words."""
    g = grams(h, k)
    parts, sizes = [], np.zeros(len(bounds), np.int64)
    for d in range(len(bounds) - 1):
        a, b = bounds[d], bounds[d + 1]
        n = b - a
        if n >= k:
            s = np.sort(g[a : b - k + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
        elif n:
            s = mix(np.array([sum(int(x) * int(m) for x, m in zip(h[a:b], _MIX[k:])) + int(n)], dtype=object).__mod__(2**64).astype(np.uint64))
        else:
            s = g[:0]
        parts.append(s)
        sizes[d + 1] = len(s)
    return (np.concatenate(parts) if parts else g[:0]), np.cumsum(sizes)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Wrapping sum of each segment."""
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def int64_lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
