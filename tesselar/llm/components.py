"""Connected components of a graph held in tables, by contraction.

Each round every node joins its neighbour of least rank, where ranks are drawn anew by hashing; nodes that nobody joined
vanish, and edges are renamed and made distinct. The number of nodes falls by a constant share a round whatever the shape of the
graph. Aggregates are combined before the shuffle, and joins are between written tables, so a node with many edges can be split.
Once no more than LOCAL_EDGES are left, one task ends the work: that many fit in a few megabytes, whatever the input was.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidied

LOCAL_EDGES = 200_000


def _least(nodes: Column, salt: int) -> Column:
    return F.min(F.struct(F.xxhash64(nodes, F.lit(salt)).alias("h"), nodes.alias("v")))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "to"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b: longs), two nodes having one root if a path joins them."""
    edges = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps, salt = [], 0
    while True:
        left = edges.count()
        if not left:
            break
        if left <= LOCAL_EDGES:
            steps.append(scratch.save(edges.coalesce(1).mapInArrow(tidied(_local), "node long, to long"), "step"))
            break
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(_least(F.col("b"), salt).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(salt)).alias("h"), F.col("a").alias("v"))
        step = scratch.save(best.select(F.col("a").alias("node"), F.least("m", own)["v"].alias("to")), "step")
        steps.append(step)
        moved = edges.join(step.withColumnsRenamed({"node": "a", "to": "x"}), "a").join(step.withColumnsRenamed({"node": "b", "to": "y"}), "b")
        smaller = scratch.save(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        scratch.drop(edges)
        edges, salt = smaller, salt + 1
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def follow(found: DataFrame, step: DataFrame) -> DataFrame:
        found = scratch.save(found, "roots")
        return found.join(step.withColumnsRenamed({"node": "root", "to": "next"}), "root", "left").select("node", F.coalesce("next", "root").alias("root"))

    return reduce(follow, steps[1:], steps[0].withColumnRenamed("to", "root"))
