"""Connected components by alternating star contraction (large star, small star), on shuffled edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; the component is its smallest node.

    Every round shrinks the edges: a node's larger neighbours are linked to its smallest neighbour (large
    star), then its smaller ones (small star). The minimum is taken by a group aggregate and joined
    back, so no node's neighbours are gathered, however many; as the minima are a stored table, Spark sends them to all tasks while
    they are small, and can split a hub's edges beyond. Ends when all edges form stars. Edges with a null end join nothing."""
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    n = now.count()  # no round has more edges
    while True:
        # Large star, seen from both ends: neighbours above a node go to its smallest neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), 2 * n)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its neighbours below go to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = stored(small.where("u <> v").distinct(), n)
        # A forest of stars: no node has two parents, and no parent has one.
        many = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        if many and new.join(new.select(F.col("u").alias("x")), F.col("v") == F.col("x"), "left_semi").isEmpty():
            break
        now = new
    leaves = new.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
