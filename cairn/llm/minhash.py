"""Near-duplicate grouping: SuperMinHash signatures, banding, exact verification, union-find.

SuperMinHash (Ertl 2017): each element walks a random permutation of the registers, its j-th step
offering j + uniform. Registers are therefore ranks without repetition per element, which lowers the
variance, and an element stops as soon as no register can still fall. Here all elements of a slice
take step j together and a text drops out once its highest register lies under j + 1; the signatures
are the same as one element after the other would give.

Every decision is exact: bands only propose, and a link counts once the words of both texts confirm it.
Texts of the same words are one class (by a cryptographic digest). In each bucket of a band all members
are checked against its least member first; then components are formed. Members of buckets that are still
in several components, of whatever size, never make all pairs: they go through an exact prefix join. Sets
in which shingles stand in the order of their frequency can only reach the similarity if they share one of
their first n - ceil(similarity * n) + 1 shingles, and if enough shingles follow the first that they share;
so what many texts have in common (a template, a notice) proposes nothing, and neither do the copies of a
large cluster that are in one component. What is left of a pair that the register sketches don't tell
apart (one at 0.8 is lost there with a chance of 1e-9) is confirmed on the words.

Edge cases: null or wordless text has no shingles, stays alone and is kept; fewer words than a
shingle give one shingle; a row with a null id is returned alone, with a null component, kept; rows
with equal ids are one node. Very long texts are worked on whole, an empty table gives no rows, and
extra columns of any name are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K
from ._shared import components, cut, drop, text_id

BANDS, ROWS = 28, 5  # a pair at similarity 0.8 misses every band with probability 1.5e-5
SKETCH = 64  # registers kept, a byte each: such a pair agrees in under half of them with probability 1e-9
MOST = 4096  # members of a prefix shingle that one task pairs; more are split among tasks
PAIRS = 1 << 18  # pairs that are compared at once
U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)


def superminhash(values: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """Registers (texts x m) of concatenated distinct hashes; level << 32 | fraction, all ones where there is no element."""
    n_docs = len(bounds) - 1
    reg = np.full(n_docs * m, np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), np.diff(bounds))

    def offer(v, d, j, spot):
        np.minimum.at(reg, d * m + spot, (U(j) << U(32)) | (v >> U(32)))

    def draw(v, j):
        x = K.mix(v + U((int(_STEP) * (j + 1)) % 2**64))
        return x, (j + (((x & U(0xFFFFFFFF)) * U(m - j)) >> U(32))).astype(np.int64)

    x, k = draw(values, 0)
    offer(x, doc, 0, k)
    top = reg.reshape(n_docs, m).max(1) if n_docs else reg
    open_docs = top >= (U(1) << U(32))
    todo = np.flatnonzero(open_docs & (np.diff(bounds) > 0))
    lo = 0
    sizes = np.diff(bounds)[todo]
    while lo < len(todo):  # permutations are kept only for texts that need more steps, so many at a time
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), 60_000)) + lo)
        some = todo[lo:hi]
        own = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in some])
        v, d = values[own], doc[own]
        perm = np.tile(np.arange(m, dtype=np.uint8), (len(own), 1))
        row = np.arange(len(own))
        perm[row, 0], perm[row, k[own]] = perm[row, k[own]], perm[row, 0].copy()
        for j in range(1, m):
            x, spot = draw(v, j)
            at = perm[row, spot]
            perm[row, spot] = perm[row, j]
            perm[row, j] = at
            offer(x, d, j, at.astype(np.int64))
            alive = reg.reshape(n_docs, m)[some].max(1) >= (U(j + 1) << U(32))
            if not alive.all():
                gone = np.zeros(n_docs, bool)
                gone[some[~alive]] = True
                some = some[alive]
                if not len(some):
                    break
                keep = ~gone[d]
                v, d, perm = v[keep], d[keep], perm[keep]
                row = np.arange(len(v))
        lo = hi
    return reg.reshape(n_docs, m)


def _sets(rb, buf, offsets, k, fold):
    low = K.lower(buf) if fold else buf
    start, end, bounds = K.words(low, offsets)
    return K.shingles(K.word_hashes(low, start, end), bounds, k), (low, start, end, bounds)


def _sign(batches, k: int, bands: int, rows: int, fold: bool):
    for rb, buf, offsets in K.slices(batches, "text"):
        (values, bounds), words = _sets(rb, buf, offsets, k, fold)
        reg = superminhash(values, bounds, bands * rows)
        keys = K.mix(K.segment_sums(K.mix(reg.ravel() + np.tile(np.arange(rows, dtype=np.uint64), len(reg) * bands) * _STEP), np.arange(0, reg.size + 1, rows)) + np.tile(np.arange(1, bands + 1, dtype=np.uint64), len(reg)))
        n = np.diff(bounds)
        yield pa.RecordBatch.from_arrays([
            rb.column(0), pa.array(n), pa.array(K.digests(*words), pa.binary()),
            K.int64_lists(keys.reshape(-1, bands)[n > 0].ravel(), np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])),
            pa.FixedSizeListArray.from_arrays(pa.array((reg[:, :SKETCH] & U(0xFF)).astype(np.uint8).view(np.int8).ravel()), min(SKETCH, bands * rows)).cast(pa.list_(pa.int8())),
        ], ["doc_id", "n", "digest", "bands", "sketch"])


class Texts:
    """Some texts, and whether pairs of them are similar: by shingle hashes, confirmed on the words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, k: int, fold: bool):
        self.k, self.buf = k, K.lower(buf) if fold else buf
        self.start, self.end, self.bounds = K.words(self.buf, offsets)
        g = K.grams(K.word_hashes(self.buf, self.start, self.end), k)
        self.hashes, self.places = [], []
        one, two = [], []
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            own = g[a : max(a, b - k + 1)]
            order = np.argsort(own, kind="stable")
            h = own[order]
            new = np.ones(len(h), bool)
            np.not_equal(h[1:], h[:-1], out=new[1:])
            at = order + a
            first = np.flatnonzero(new)
            again = np.flatnonzero(~new)
            one.append(at[again])
            two.append(at[again - 1])
            self.hashes.append(h[first])
            self.places.append(at[first])
        self.sizes = [len(h) for h in self.hashes]
        # texts with two shingles of one hash: rare, and compared as sets of words
        x, y = np.concatenate(one or [self.bounds[:0]]), np.concatenate(two or [self.bounds[:0]])
        bad = ~self._alike(x, y)
        self.odd = set((np.searchsorted(self.bounds, x[bad], "right") - 1).tolist())

    def _alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the shingles at words x and y are the same."""
        same = np.ones(len(x), bool)
        for j in range(self.k if len(x) else 0):
            same &= K.same_words(self.buf, self.start, self.end, x + j, y + j)
        return same

    def _set(self, i: int) -> set[tuple[bytes, ...]]:
        a, b = self.bounds[i], self.bounds[i + 1]
        w = [self.buf[x:y].tobytes() for x, y in zip(self.start[a:b], self.end[a:b])]
        return {tuple(w[j : j + self.k]) for j in range(max(1, len(w) - self.k + 1))} if w else set()

    def _exact(self, i: int, j: int, percent: int) -> bool:
        x, y = self._set(i), self._set(j)
        return bool(x) and 100 * len(x & y) >= percent * len(x | y)

    def similar(self, pairs: list[tuple[int, int]], percent: int) -> list[bool]:
        """For each pair whether 100 * intersection >= percent * union."""
        out, one, two, whose = [], [], [], []
        for p, (i, j) in enumerate(pairs):
            m, n = self.sizes[i], self.sizes[j]
            if not m or not n or i in self.odd or j in self.odd:  # less than a shingle of words, or colliding ones
                out.append(self._exact(i, j, percent))
                continue
            x, y = (i, j) if m >= n else (j, i)
            at = np.searchsorted(self.hashes[x], self.hashes[y])
            hit = np.flatnonzero(self.hashes[x][np.minimum(at, len(self.hashes[x]) - 1)] == self.hashes[y])
            out.append(100 * len(hit) >= percent * (m + n - len(hit)))
            if out[-1]:
                one.append(self.places[x][at[hit]])
                two.append(self.places[y][hit])
                whose.append(np.full(len(hit), p))
        if one:
            for p in np.unique(np.concatenate(whose)[~self._alike(np.concatenate(one), np.concatenate(two))]).tolist():
                out[p] = self._exact(*pairs[p], percent)
        return out


def _confirm(batches, k: int, fold: bool, percent: int):
    """Similar pairs (a, b) of rows (a, salt, side, doc_id, text), sorted: each group's hub comes before its partners."""
    group, hubs = None, []  # the texts of the hub whose group goes on in the next slice
    for rb, buf, offsets in K.slices(batches, "text"):
        data = buf.tobytes()
        texts = [t for _, t in hubs] + [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        own = [(group, i) for i in range(len(hubs))]  # hubs among texts
        pairs, found = [], []
        a, salt, side, ids = (rb.column(i).to_pylist() for i in range(4))
        shift = len(hubs)
        for r in range(rb.num_rows):
            if (a[r], salt[r]) != group:
                group, own = (a[r], salt[r]), []
            if side[r] == 0:
                own.append((group, r + shift))
                continue
            for _, h in own:
                pairs.append((h, r + shift))
                found.append((a[r], ids[r]))
        if pairs:
            whole = np.frombuffer(b"".join(texts), np.uint8)
            good = Texts(whole, np.cumsum([0, *map(len, texts)]), k, fold).similar(pairs, percent)
            links = sorted({f for f, ok in zip(found, good) if ok})
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])
        hubs = [(g, texts[h]) for g, h in own]


def _verified(pairs: DataFrame, docs: DataFrame, k: int, fold: bool, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    The hub a of a star may have any number of partners: its text goes to each salt of 500 of them. Texts
    move twice: to the list of the groups they are in, and to those groups."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 500).cast("int").alias("salts"))
    hubs = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("a").alias("doc_id"))
    partners = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("side"), F.col("b").alias("doc_id"))
    # merged at every size: few ids would be broadcast, many not, and small runs then tell nothing of large ones
    rows = docs.join(hubs.union(partners).hint("merge"), "doc_id").select("a", "salt", "side", "doc_id", "text")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "side").mapInArrow(partial(_confirm, k=k, fold=fold, percent=percent), "a long, b long").distinct()


def _tokens(batches, k: int, fold: bool):
    """A row for each shingle of each text (row, doc_id, text)."""
    for rb, buf, offsets in K.slices(batches, "text"):
        (values, bounds), _ = _sets(rb, buf, offsets, k, fold)
        n = np.diff(bounds)
        own = np.repeat(np.arange(len(n)), n)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *(rb.column(i).take(pa.array(own)) for i in range(2)), pa.array(n[own])], ["key", "row", "doc_id", "n"])


def _prefixes(texts: DataFrame, k: int, fold: bool, percent: int) -> DataFrame:
    """(key, doc_id, n, rest): the shingles one of which a text shares with whatever is similar to it.

    Shingles of a single text are shared with none, the others stand in the order of their frequency; rest
    is how many there are from this one on, so no more than these are shared if it is the first that is."""
    tokens = texts.select("row", "doc_id", "text").mapInArrow(partial(_tokens, k=k, fold=fold), "key long, row long, doc_id long, n long").repartition("key")
    often = tokens.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    last = Window.partitionBy("row").orderBy(F.desc("c"), F.desc("key"))
    return tokens.join(often.hint("merge"), "key").withColumn("rest", F.row_number().over(last).cast("long")).where(100 * F.col("rest") >= percent * F.col("n")).select("key", "doc_id", "n", "rest")


def _apart(batches, percent: int):
    """Pairs (a, b) in different components, of the rows of each cell (key, p, q, block, comp, doc_id, n, rest, sketch), sorted by the first three and comp."""
    left = None
    for rb in batches:
        rows = pa.Table.from_batches([rb])
        rows = pa.concat_tables([left, rows]) if left is not None else rows
        cell = np.stack([rows.column(i).to_numpy() for i in range(3)])
        new = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1
        done = int(new[-1]) if len(new) else 0
        left = rows.slice(done)
        yield from _cells(rows.slice(0, done), np.concatenate([[0], new]), percent)
    if left is not None and left.num_rows:
        yield from _cells(left, np.array([0, left.num_rows]), percent)


def _cells(rows: pa.Table, bounds: np.ndarray, percent: int):
    if not rows.num_rows:
        return
    p, q, block, comp, ids, n, rest = (rows.column(i).to_numpy() for i in range(1, 8))
    sketch = rows.column(8).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    found = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        one, two = (np.arange(lo, hi),) * 2 if p[lo] == q[lo] else (lo + np.flatnonzero(block[lo:hi] == x[lo]) for x in (p, q))
        if not len(one):  # a cell of two blocks, of which one is empty
            continue
        ends = [0, *(np.flatnonzero(np.diff(comp[one])) + 1).tolist(), len(one)]
        for s, e in zip(ends[:-1], ends[1:]):  # a component against the others; its own pairs are never made
            y = two[e:] if p[lo] == q[lo] else two[comp[two] != comp[one[s]]]
            step = max(1, PAIRS // max(1, len(y)))
            for at in range(s, e if len(y) else s, step):
                x = one[at : min(e, at + step)]
                i, j = np.nonzero((100 + percent) * np.minimum(rest[x][:, None], rest[y][None]) >= percent * (n[x][:, None] + n[y][None]))
                for c in range(0, len(i), PAIRS):
                    u, v = x[i[c : c + PAIRS]], y[j[c : c + PAIRS]]
                    ok = 160 * (sketch[u] == sketch[v]).sum(1) >= percent * sketch.shape[1]
                    found.append(np.stack([np.minimum(ids[u[ok]], ids[v[ok]]), np.maximum(ids[u[ok]], ids[v[ok]])]))
        if sum(f.shape[1] for f in found[-64:]) > PAIRS or len(found) > 4096:
            yield _batch(found)
            found = []
    if found:
        yield _batch(found)


def _batch(found: list[np.ndarray]) -> pa.RecordBatch:
    """Pairs, each once."""
    pairs = np.unique(np.concatenate(found, 1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _left_apart(members: DataFrame, comps: DataFrame, reps: DataFrame, texts: DataFrame, k: int, fold: bool, percent: int, most: int) -> DataFrame | None:
    """Candidate pairs of the members of buckets that aren't all in one component, by an exact prefix join; None if there are no such buckets.

    A shingle of more than ``most`` members is a grid of blocks of ``most``."""
    named = comps.withColumnRenamed("node", "doc_id")
    of = members.join(named, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    mixed = of.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    left = cut(of.join(mixed, "key").select("doc_id", "comp").distinct(), "apart")
    if left.isEmpty():
        return None
    firsts = cut(_prefixes(texts.join(left.hint("merge"), "doc_id", "left_semi"), k, fold, percent).join(left.hint("merge"), "doc_id"), "prefixes")
    sizes = firsts.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    m = firsts.join(sizes.select("key", F.ceil(F.col("c") / most).cast("int").alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})
    m = m.join(reps.select("doc_id", "sketch").hint("merge"), "doc_id").select("key", "p", "q", "block", "comp", "doc_id", "n", "rest", "sketch")
    return m.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "comp").mapInArrow(partial(_apart, percent=percent), "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, fold_case: bool = True, bands: int = BANDS, rows: int = ROWS, most: int = MOST) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of df.

    Documents are linked if percent * union <= 100 * intersection of their shingle sets; a component
    is what links reach, named by its least id, and only that document is kept."""
    docs = text_id(df, id_col, text_col)
    signed = cut(docs.mapInArrow(partial(_sign, k=shingle, bands=bands, rows=rows, fold=fold_case), "doc_id long, n long, digest binary, bands array<long>, sketch array<tinyint>"), "signed")
    classes = signed.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = signed.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").where("n > 0")
    rows_ = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = rows_.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("key", "a")
    # only what shares a bucket goes on
    members = cut(rows_.join(buckets, "key").distinct(), "members")
    stars = members.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    # of the texts only those that share a bucket go on; rows with equal ids are told apart by their number
    near = cut(docs.join(members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").withColumn("row", F.monotonically_increasing_id()), "near")
    edges = cut(_verified(cut(stars, "stars"), near, shingle, fold_case, percent), "edges")
    comps = components(edges)
    rest = _left_apart(members.where("doc_id <> a"), comps, reps, near, shingle, fold_case, percent, most)
    if rest is not None and not (rest := cut(rest, "rest")).isEmpty():
        more = cut(_verified(rest, near, shingle, fold_case, percent), "edges")
        if not more.isEmpty():
            comps = components(edges.union(more))
    drop(near)
    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n", "digest").join(named, "digest", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
