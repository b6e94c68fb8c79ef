"""Shards by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split.

A document's bucket is the shortest prefix of its id's hash whose documents together fit the byte
limit. Bytes are summed once by prefixes of some bits, about sixteen for each shard that the total will
need; sums of shorter prefixes follow from those, so the directory grows with the shards and never sees
documents. Where these bits don't do, the documents under those prefixes alone go on to further bits,
up to the 60 bits of the hash.

Edge cases: null text has no bytes; null ids share one hash; a document larger than the limit is a
shard of its own, and rows with one and the same id can't be told apart by any bit: such shards are
marked oversized. An empty table has no shards; very long texts count whole. Extra columns of any name
are ignored, and kept by ``write_shards``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut

LIMIT = 512 << 10
BITS = 60


def _directory(todo: DataFrame, base: int, top: int, limit: int) -> DataFrame:
    """(p, depth, prefix, shard_bytes): for each prefix p of ``top`` bits its bucket, of ``base`` bits at least; depth null where p itself is oversized."""
    sums = todo.groupBy(F.shiftright("h", BITS - top).alias("p")).agg(F.sum("n_bytes").alias("b"))
    levels = sums.select("p", "b", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("d")).withColumn("q", F.expr(f"shiftright(p, {top} - d)"))
    totals = levels.groupBy("d", "q").agg(F.sum("b").alias("t"))
    fits = levels.join(totals, ["d", "q"]).where((F.col("t") <= limit) | (F.col("d") == BITS))
    best = fits.groupBy("p").agg(F.min(F.struct("d", "q", "t")).alias("best"))
    return sums.select("p").join(best, "p", "left").select("p", F.col("best.d").alias("depth"), F.col("best.q").alias("prefix"), F.col("best.t").alias("shard_bytes"))


def shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, oversized): shard is the bucket's prefix in bits."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")
    todo = cut(df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"), h.alias("h")), "shards")
    out, base = None, 0
    total = todo.agg(F.sum("n_bytes")).first()[0] or 0
    top = min(BITS, max(1, math.ceil(math.log2(max(total / limit, 1))) + 4))
    while True:
        directory = cut(_directory(todo, base, top, limit), "directory")
        placed = todo.withColumn("p", F.shiftright("h", BITS - top)).join(directory, "p")
        done = placed.where("depth is not null")
        out = done if out is None else out.union(done)
        if directory.where("depth is null").isEmpty():
            break
        todo, base = cut(placed.where("depth is null").select("doc_id", "n_bytes", "h"), "shards"), top
        top = min(BITS, base + 8)  # few are left, by chance or for their size
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return out.select("doc_id", "n_bytes", bits.alias("shard"), "depth", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, shard_col: str = "shard") -> None:
    """Writes df in one directory for each shard, named by ``shard_col``. Shards are bounded, so a task that writes one is too."""
    if shard_col in df.columns:
        raise ValueError(f"the table has a column {shard_col}: name another shard_col")
    # inner names, so that no column of df can clash
    names = [f"c{i}" for i in range(len(df.columns))]
    of = shards(df, id_col, text_col, limit).select(F.col("doc_id").alias("of"), F.concat(F.lit("s"), "shard").alias("in_shard")).distinct()
    joined = df.toDF(*names).join(of, F.col(names[df.columns.index(id_col)]).eqNullSafe(F.col("of"))).select(*names, "in_shard").toDF(*df.columns, shard_col)
    joined.repartition(shard_col).write.partitionBy(shard_col).parquet(path)


ORACLE = f"""
with d as (
  select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents
), levels as (
  select doc_id, n_bytes, l::int as depth, h >> (60 - l) as prefix from d, unnest(range(0, 61)) as u(l)
), sized as (
  select *, sum(n_bytes) over (partition by depth, prefix)::bigint as shard_bytes from levels
), best as (
  select doc_id, n_bytes, min(depth) as depth from sized where shard_bytes <= {LIMIT} or depth = 60 group by all
)
select doc_id, n_bytes, case when depth = 0 then '' else lpad(bin(prefix), depth, '0') end as shard, depth, shard_bytes, shard_bytes > {LIMIT} as oversized
from best join sized using (doc_id, n_bytes, depth)
"""
