"""URL rules in sorted digest arrays: memory-mapped 64-bit xxhash keys, binary search, confirmed strings.

A rule is ``host/path``. It fits a url if its host is the url's host or a domain above it, and the
url's path starts with its path; the longest fitting rule decides (between equal lengths the longer
host). The index is a set of files in the shared folder, one shard for each range of keys: the sorted
keys, the offsets of the rules' strings and the strings. Executors map the files, so an index larger
than memory works and nothing is broadcast. For every suffix of the host and every rule-path length,
the candidate strings' digests are looked up by one vectorised binary search a batch; a hit counts
only if the stored string is the candidate's, so colliding digests do no harm.

Edge cases: a null url, or one without ``://``, has an empty host and path and no rule; letters other
than A-Z are not folded, neither in hosts of urls nor of rules; of equal rules with different verdicts
block wins; a null rule, or one without ``/``, fits nothing, and neither does one with a null verdict;
an empty rule table gives every url the default verdict. Repeated rows and null ids are judged like any
other, very long urls whole; an empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._shared import local_path, scratch

_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def split(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lowered, and path of a url."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[stop:]
    stop2 = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return rest[:stop].translate(_UPPER), path[:stop2]


def _write(rows: pd.DataFrame, folder: str) -> pd.DataFrame:
    """One shard of the index; written under another name first, so that a repeated task does no harm."""
    shard = int(rows["shard"].iloc[0])
    data = [r.encode() for r in rows["rule"]]
    keys = np.array([xxhash.xxh64_intdigest(x) for x in data], np.uint64)
    order = np.argsort(keys, kind="stable")
    data = [data[i] for i in order]
    parts = {
        "keys": keys[order],
        "offsets": np.cumsum([0, *map(len, data)]).astype(np.int64),
        "strings": np.frombuffer(b"".join(data) or b"\0", np.uint8),
        "verdicts": (rows["verdict"].to_numpy()[order] == "block").astype(np.uint8),
    }
    for name, a in parts.items():
        own = f"{folder}/{shard:05d}.{name}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(own, "wb") as f:
            np.save(f, a)
        os.replace(own, f"{folder}/{shard:05d}.{name}.npy")
    lengths = sorted({len(x) - x.index(b"/") for x in data})
    return pd.DataFrame({"shard": [shard], "n": [len(data)], "lengths": [lengths]})


class Index:
    """Mapped shards of an index; ``lengths`` are the path lengths that its rules have."""

    def __init__(self, folder: str, shards: dict[int, int], lengths: list[int], bits: int):
        self.folder, self.shards, self.lengths, self.bits = folder, shards, lengths, bits
        self._open: dict[int, tuple[np.ndarray, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def shard(self, s: int) -> tuple[np.ndarray, ...]:
        if s not in self._open:
            self._open[s] = tuple(np.load(f"{self.folder}/{s:05d}.{n}.npy", mmap_mode="r") for n in ("keys", "offsets", "strings", "verdicts"))
        return self._open[s]

    def find(self, texts: list[bytes]) -> np.ndarray:
        """For each string 0 (no rule), 1 (allow) or 2 (block)."""
        keys = np.fromiter((xxhash.xxh64_intdigest(x) for x in texts), np.uint64, len(texts))
        out = np.zeros(len(texts), np.int8)
        of = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        for s in np.unique(of):
            if int(s) not in self.shards:
                continue
            own = np.flatnonzero(of == s)
            sorted_keys, offsets, strings, verdicts = self.shard(int(s))
            lo, hi = np.searchsorted(sorted_keys, keys[own], "left"), np.searchsorted(sorted_keys, keys[own], "right")
            for i, a, b in zip(own[hi > lo], lo[hi > lo], hi[hi > lo]):
                for j in range(a, b):
                    if strings[offsets[j] : offsets[j + 1]].tobytes() == texts[i]:
                        out[i] = 1 + int(verdicts[j])
        return out


SHARD_RULES = 250_000


def build(rules: DataFrame, bits: int | None = None) -> Index:
    """Writes the index of (rule, verdict) rows to the shared folder, in 2**bits shards.

    Where ``bits`` isn't given it follows from a count, so that a shard has about ``SHARD_RULES`` rules."""
    spark = rules.sparkSession
    ship(spark)
    folder = local_path(scratch(spark, "urls"))
    os.makedirs(folder, exist_ok=True)
    host = F.translate(F.substring_index("rule", "/", 1), "".join(map(chr, _UPPER)), "".join(_UPPER.values()))
    rules = rules.where("rule is not null and verdict is not null and instr(rule, '/') > 0").select(F.concat(host, F.expr("substring(rule, instr(rule, '/'))")).alias("rule"), (F.col("verdict") == "block").alias("block"))
    # equal rules are one before they meet in a shard
    rules = rules.groupBy("rule").agg(F.when(F.max("block"), "block").otherwise("allow").alias("verdict"))
    if bits is None:
        bits = max(0, math.ceil(math.log2(max(1, rules.count()) / SHARD_RULES)))
    digest = F.pandas_udf(lambda s: s.map(lambda x: xxhash.xxh64_intdigest(x.encode()) >> (64 - bits) if bits else 0), "long")
    write: Callable[[pd.DataFrame], pd.DataFrame] = lambda rows: _write(rows, folder)
    made = rules.withColumn("shard", digest("rule")).groupBy("shard").applyInPandas(write, "shard long, n long, lengths array<long>")
    rows = made.collect()  # a row for each shard
    return Index(folder, {r.shard: r.n for r in rows}, sorted({x for r in rows for x in r.lengths}), bits)


def _judge(batches, index: Index, default: str):
    for b in batches:
        parts = [split(u) for u in b.column(1).to_pylist()]
        texts, owner, rank = [], [], []
        for i, (host, path) in enumerate(parts):
            if not host:
                continue
            wide = path.encode()
            at = 0
            while True:
                suffix = host[at:].encode()
                for n in index.lengths:
                    if n > len(wide):
                        break
                    texts.append(suffix + wide[:n])
                    owner.append(i)
                    rank.append((len(suffix) + n, len(suffix)))
                at = host.find(".", at) + 1
                if not at:
                    break
        best: dict[int, tuple] = {}
        hits = index.find(texts)
        for j in np.flatnonzero(hits):
            best[owner[j]] = max(best.get(owner[j], ((0, 0), b"", 0)), (rank[j], texts[j], int(hits[j])))
        found = [best.get(i) for i in range(len(parts))]
        yield pa.RecordBatch.from_arrays([
            b.column(0), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()),
            pa.array([f and f[1].decode() for f in found], pa.string()), pa.array([("", "allow", "block")[f[2]] if f else default for f in found], pa.string()),
        ], ["page_id", "host", "path", "rule", "verdict"])


def judge(df: DataFrame, index: Index, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict); a url that no rule fits gets the default verdict."""
    ship(df.sparkSession)
    urls = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return urls.mapInArrow(partial(_judge, index=index, default=default), "page_id long, host string, path string, rule string, verdict string")


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "rule string, verdict string")


ORACLE = r"""
with p as (
  select page_id, case when url is null or position('://' in url) = 0 then '' else substr(url, position('://' in url) + 3) end as rest from pages
), h as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from p
), rules(rh, rp, v) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), f as (
  select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(v, length(rh || rp)) as v
  from h, rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from h left join f using (page_id)
"""
