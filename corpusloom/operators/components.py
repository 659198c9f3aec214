"""Connected components by rounds of contraction.

Each round gives every node the smallest node next to it, moves the links to those and drops what has become
a loop; nodes are compared in the order of a hash, so the number of nodes falls by a constant factor a round whatever
the shape. Links are kept once, results of a round are written to the shared folder, and joins are plain equi-joins
of two such tables, whose large partitions the engine can split: a hub's links need not fit in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.storage import parts_for, saved

#: A row of links or roots, about.
ROW_BYTES = 64


def contracted(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has a link to another; root is the same for all nodes of a component and one of them."""
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = saved(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    parents: DataFrame | None = None
    most = 1
    while n := edges.count():
        parts = parts_for(edges.sparkSession, 2 * n, ROW_BYTES)
        most = max(most, parts)
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(key("b")).alias("m"))
        step = saved(least.select(F.col("a").alias("node"), F.least(F.col("m"), key("a"))["v"].alias("root")), "parents", parts)
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").select("ra", "b")
        moved = moved.join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        moved = moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if parents is None:
            parents = step
        else:
            up = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            parents = saved(parents.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "parents", most)
        edges = saved(moved, "links", parts)
    return parents if parents is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
