"""Distributed connected components, and what the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources.scratch import cut, drop, local_path, remove, scratch, shared_dir

__all__ = ["components", "cut", "drop", "local_path", "remove", "scratch", "shared_dir", "text_id"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (node, component), component the least node.

    Union-find in two tiers. Within a partition of edges a forest is built in memory, bounded by the
    partition, and each tree becomes a star: edges never exceed nodes from then on. Between partitions,
    alternating large-star and small-star rounds (Kiveris et al. 2014) hook and compress until nothing
    changes. Every round is cut to the shared folder. Only a count and a checksum reach the driver.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    e = cut(e.mapInArrow(_forest, "u long, v long").distinct(), "cc")
    before = None
    for _ in range(60):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = cut(small.where("u <> v").distinct(), "cc")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(e)
        e = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    nodes = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(nodes.select("node", F.col("node").alias("component")))


def _forest(batches):
    import numpy as np
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while x != root:
            x, parent[x] = parent.get(x, x), root
        return root

    def star():
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.int64)), pa.array(np.array([find(x) for x in nodes], np.int64))], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(u), find(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 1_000_000:  # bounded memory: what is left of it goes on to the rounds
            yield star()
            parent.clear()
    if parent:
        yield star()


def text_id(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under its own names; clashing extra columns never meet them."""
    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
