"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bitloom.llm.common import freeing, settle

#: Up to this many edges are solved by one task with a union-find; more are first contracted in rounds.
LOCAL_EDGES = 500_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """Node and component (its smallest node) for every node of ``edges`` (columns u and v, longs).

    While there are more than ``LOCAL_EDGES``, alternates two steps until nothing changes: each
    node hands its larger neighbours, then its smaller ones, to its smallest neighbour.  A node's minimum is a partial
    aggregate, and the joins on a node are plain equi-joins that adaptive execution may
    split, so a node with very many neighbours is no task of its own.  Each round is
    settled, and the rounds grow with the logarithm of the longest path.
    """
    current = settle(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(current)
    while mark[0] > LOCAL_EDGES:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        large = large.join(small_least, "u")
        small = large.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(large.select("u", F.col("m").alias("v")))
        current = settle(small.where("u != v").distinct(), "edges")
        after = _mark(current)
        if after == mark:
            break
        mark = after
    if mark[0] <= LOCAL_EDGES:
        return current.coalesce(1).mapInArrow(freeing(_union_find), "node long, component long")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _union_find(batches):
    """All edges of a graph of bounded size to (node, smallest node of its component)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])
