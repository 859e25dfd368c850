"""Connected components of an edge table by alternating large-star and small-star steps.

Each step finds every node's smallest neighbour by a sum of partial minima and joins it back by merging, so that a node
with most of the edges is no task of its own (such joins are split where they are skewed) and nothing is broadcast. A step
is written to the shared folder: the lineage stays short and nothing is collected. Nodes are longs; a component is named
by its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges with m, the smallest b of their a."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")).hint("merge"), "a")


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """node, root for every node that has an edge to another; edges has long columns a and b."""
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    step, mark = 0, None
    while True:
        # large star: each node's larger neighbours are linked to its smallest one
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # small star: each node's smaller neighbours, and it, are linked to the smallest of them
        small = _with_least(large)
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = small.select("e.a", "e.b").where("a <> b").distinct()
        step += 1
        after = scratch.save(small, f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark, now = seen, after
