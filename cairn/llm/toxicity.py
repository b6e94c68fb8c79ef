"""Toxicity by multiple-instance learning: sentences are instances, documents carry the labels.

A sentence's probability is a logistic of its features (words and word prefixes, folded to lower
case); a document's is the noisy-or of its sentences, 1 - prod(1 - p). A sentence whose features don't
raise it above the bias, as one without any, counts as 0 in it: a document of such sentences alone scores
less than one sentence at the bias (4.5e-5), the longer the more, however long it is. Only document labels are known;
the gradient of the noisy-or puts the blame on the sentences that explain them, and the same sentence
probabilities then locate what offends.

Training takes a bounded sample of labelled documents: at most ``SAMPLE`` rows in the order of a hash of
their ids, and of these at most ``SAMPLE_BYTES`` of text (whole texts; one that doesn't fit is passed
over). Of texts in the sample that are much alike (``COPY`` of sixteen five-word minhashes shared with an
earlier one, an estimated similarity of 0.3) the first is learned, so that neither a text found in many
copies nor a passage that many texts are made of counts more than once. Features are
selected by their association with the label and are kept under 64-bit keys, so a word that was not
in the sample can't collide with one that was. The model is a few thousand numbers at most
(``features``), and is what is sent to the executors. Scoring scans the documents where they lie.

Edge cases: null, empty or wordless texts have no sentence and score 0; without a positive label in
the sample every score is 0; a null id is scored like any other and isn't held out; repeated rows get
equal scores; very long texts are scored whole; an empty table gives no rows. Extra columns of any
name are ignored, and kept by ``drop_toxic``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import _kernel as K
from ._shared import text_id

U = np.uint64
SAMPLE, SAMPLE_BYTES, FEATURES, THRESHOLD = 4000, 32 << 20, 4000, 0.3
COPY = 5  # of sixteen minhashes
PREFIXES = (4, 5, 6, 7, 8)
_DELIM = np.zeros(256, bool)
_DELIM[:48] = _DELIM[58:65] = _DELIM[91:97] = _DELIM[123:128] = True
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord("!"), ord("?"), ord("\n")]] = True


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the accented Latin-1 letters, byte by byte."""
    out = K.lower(buf)
    if len(out) > 1:
        wide = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][wide] += 32
    return out


@dataclass
class Instances:
    """Words of some texts with their sentences; features are made from them on demand."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sentence: np.ndarray  # of each word
    doc: np.ndarray  # of each sentence
    first: np.ndarray  # first word of each sentence

    def features(self):
        """(word index, key) of all features, kind by kind."""
        n = self.end - self.start
        yield np.arange(len(n)), K.word_hashes(self.buf, self.start, self.end)
        for size in PREFIXES:
            some = np.flatnonzero(n > size)
            yield some, K.mix(K.word_hashes(self.buf, self.start[some], self.start[some] + size) + U(size))


def instances(buf: np.ndarray, offsets: np.ndarray) -> Instances:
    low = fold(buf)
    start, end, bounds = K.words(low, offsets, _DELIM)
    stops = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_STOP[low], out=stops[1:])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    new = np.ones(len(start), bool)
    if len(start) > 1:
        at = stops[start]
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return Instances(low, start, end, np.cumsum(new) - 1, doc[first], first)


@dataclass
class Model:
    keys: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> U(44)).astype(np.int64)] = True

    def sentences(self, x: Instances) -> np.ndarray:
        """Each sentence's probability: exactly 0 where nothing in it speaks for toxicity."""
        z = np.full(len(x.first), self.bias)
        if not len(self.keys):
            return np.zeros(len(z))
        for word, key in x.features():
            hit = np.flatnonzero(self.seen[(key >> U(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
            good = self.keys[at] == key[hit]
            np.add.at(z, x.sentence[word[hit[good]]], self.weights[at[good]])
        return np.where(z > self.bias, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)

    def documents(self, p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Each document's score from its sentences' probabilities; those without evidence rank by their length, under a fixed bound."""
        if not len(self.keys):
            return np.zeros(n)
        many = np.bincount(doc, minlength=n)
        return np.maximum(noisy_or(p, doc, n), many / (many + 1) / (1 + np.exp(-self.bias)))


def noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.abs(np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n)))


def train(texts: list[str], toxic: list[int], features: int = FEATURES, rounds: int = 600) -> Model:
    """Fits the noisy-or of sentence logistics to document labels (Adam, with a penalty on weights)."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    y = np.array(toxic, float)
    if not y.any():
        return none
    keep = np.ones(len(y), bool)
    seen: dict[tuple[int, int], list[int]] = {}
    n = len(y)

    def parts():
        """Slices of the sample: the working arrays of one at a time are in memory."""
        batches = [pa.RecordBatch.from_arrays([pa.array(range(i, min(i + 500, n))), pa.array(texts[i : i + 500], pa.large_string())], ["row", "text"]) for i in range(0, n, 500)]
        for rb, buf, offsets in K.slices(batches, "text", 1 << 20):
            yield int(rb.column(0)[0].as_py()), buf, offsets

    for at, buf, offsets in parts():
        low = K.lower(buf)
        start, end, bounds = K.words(low, offsets)
        g = K.grams(K.word_hashes(low, start, end), 5)
        for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if b - a < 5:
                continue
            own = [(i, int(np.min(g[a : b - 4] ^ m))) for i, m in enumerate(K._MIX[:16])]
            shared = Counter(e for x in own for e in seen.get(x, ()))
            if max(shared.values(), default=0) >= COPY:
                keep[at + d] = False
                continue
            for x in own:
                seen.setdefault(x, []).append(at + d)
    base = (y * keep).sum() / max(1, keep.sum())
    names, df, pos = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def merged(names, df, pos):
        order = np.argsort(names, kind="stable")
        names, df, pos = names[order], df[order], pos[order]
        first = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
        return (names[first], np.add.reduceat(df, first), np.add.reduceat(pos, first)) if len(first) else (names, df, pos)

    for at, buf, offsets in parts():
        x = instances(buf, offsets)
        for word, key in x.features():
            doc = x.doc[x.sentence[word]] + at
            good = keep[doc]
            own, which = np.unique(key[good], return_inverse=True)
            pairs = np.unique(which.astype(np.int64) * n + doc[good])
            names = np.append(names, own)
            df = np.append(df, np.bincount(pairs // n, minlength=len(own)).astype(np.int32))
            pos = np.append(pos, np.bincount(pairs // n, y[pairs % n], len(own)).astype(np.int32))
        names, df, pos = merged(names, df, pos)
    z = (pos - df * base) / np.sqrt(np.maximum(df * base * (1 - base), 1e-9))
    ok = np.flatnonzero((df >= 5) & (z >= 5) & (pos >= 0.6 * df))
    ok = ok[np.argsort(-z[ok], kind="stable")[:features]]
    if not len(ok):
        return none
    ok = np.sort(ok)
    keys, odds = names[ok], np.log((pos[ok] + 0.5) / (df[ok] - pos[ok] + 0.5))
    del names, df, pos, z
    inst, feat, docs, count = [], [], [], 0
    for at, buf, offsets in parts():
        x = instances(buf, offsets)
        for word, key in x.features():
            hit = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            good = keys[hit] == key
            inst.append(x.sentence[word[good]] + count)
            feat.append(hit[good])
        docs.append(x.doc + at)
        count += len(x.doc)
    inst, feat, doc = np.concatenate(inst), np.concatenate(feat), np.concatenate(docs)
    live = keep[doc] & (np.bincount(inst, minlength=len(doc)) > 0)  # plain sentences count as 0 here too
    # Starting from each feature's own odds, and held there weakly: among features that go together the
    # noisy-or would else raise the one that explains a document first and never learn the others.
    # The bias is fixed: where documents are separable it would drift down and take words with it that
    # only ever come with others.
    bias = -10.0
    prior = np.maximum(0.0, odds - 0.7 * bias)
    w = descend(inst, feat, live, doc, y, int(keep.sum()), prior, bias, rounds)
    return Model(keys, w, float(bias))


def descend(inst, feat, live, doc, y, many: int, prior, bias: float, rounds: int) -> np.ndarray:
    """Weights after so many steps of Adam on the noisy-or's log-likelihood, pulled weakly to the prior.

    ``inst`` and ``feat`` pair the instances with their features; ``doc`` has each instance's document."""
    w = prior.copy()
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, rounds + 1):
        z = bias + np.bincount(inst, w[feat], len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        doc_p = np.clip(noisy_or(np.where(live, p, 0), doc, len(y)), 1e-9, 1)
        grad = np.where(live, p * (1 - y[doc] / doc_p[doc]), 0)
        g_all = (np.bincount(feat, grad[inst], len(w)) + 0.05 * (w - prior)) / max(1, many)
        m, v = 0.9 * m + 0.1 * g_all, 0.99 * v + 0.01 * g_all**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most`` labelled rows, and ``most_bytes`` of text, in the order of a hash of their ids."""
    some = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    some = some.where(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # bounded by the limit above
    rows = text_id(df, id_col, text_col).where("text is not null").join(F.broadcast(some), "doc_id")
    sizes = rows.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "n").limit(most).collect()
    left, fit, out = most_bytes, [], set()
    for r in sizes:  # an id with a row that doesn't fit is passed over whole
        if r.n > left:
            out.add(r.doc_id)
        left -= 0 if r.doc_id in out else r.n
        fit.append(r.doc_id)
    fit = [i for i in dict.fromkeys(fit) if i not in out]
    kept = df.sparkSession.createDataFrame([(i,) for i in fit], "doc_id long")
    rows = rows.join(F.broadcast(kept), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(most).collect()
    return [r.text for r in rows], [r.y for r in rows]


def held_out(id_col: str):
    """Ids whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _score(batches, model):
    for rb, buf, offsets in K.slices(batches, "text"):
        x = instances(buf, offsets)
        p = model.value.sentences(x)
        n = len(offsets) - 1
        spans: list[list] = [[] for _ in range(n)]
        for s in np.flatnonzero(p >= 0.5):
            d, a = int(x.doc[s]), x.start[x.first[s]]
            b = x.end[(x.first[s + 1] if s + 1 < len(x.first) else len(x.start)) - 1]
            text = buf[offsets[d] : b].tobytes()
            begin = len(text[: a - offsets[d]].decode("utf-8", "ignore"))
            spans[d].append({"begin": begin, "end": len(text.decode("utf-8", "ignore")), "score": float(p[s])})
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(model.value.documents(p, x.doc, n)), pa.array(np.bincount(x.doc, minlength=n)), pa.array(spans, kind)], ["doc_id", "score", "n_sentences", "offending"])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE) -> Model:
    return train(*sample(df, labels, id_col, text_col, label_col, most))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_sentences, offending): offending has the character spans of sentences of 0.5 or more."""
    docs = text_id(df, id_col, text_col)
    made = docs.mapInArrow(partial(_score, model=df.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double, n_sentences long, offending array<struct<begin:long,end:long,score:double>>")
    return made.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending")


def _clean(batches, model, at: int, threshold: float):
    for batch in batches:
        rows = pa.RecordBatch.from_arrays([batch.column(at), pa.array(np.arange(batch.num_rows))], ["text", "row"])
        keep = np.ones(batch.num_rows, bool)
        for rb, buf, offsets in K.slices([rows], "text"):
            x = instances(buf, offsets)
            keep[np.asarray(rb.column(1))] = model.value.documents(model.value.sentences(x), x.doc, len(offsets) - 1) < threshold
        yield batch.filter(pa.array(keep))


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df without the documents that score threshold or more; all columns stay, nothing is shuffled."""
    ship(df.sparkSession)
    return df.mapInArrow(partial(_clean, model=df.sparkSession.sparkContext.broadcast(model), at=df.columns.index(text_col), threshold=threshold), df.schema)
