"""Connected components by alternating star contraction (large star, then small star), all in DataFrame operations.

Each round moves every node's edges to the least neighbour; the number of rounds grows with the logarithm of the
longest path, not with it. Minima are pre-aggregated before the shuffle and the joins are plain equi-joins, which
adaptive execution splits where a hub holds many edges. Nothing is collected; the rounds end when every edge leads from a node to a least one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import cut


def _open(e: DataFrame) -> bool:
    """Whether an edge does not end in its component's least node yet: a node has two edges, or an edge's end has one of its own."""
    several = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
    passed = e.select("u").join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return not several.unionByName(passed).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the component's id is its least node. Nulls and loops are no edges."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    while _open(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
