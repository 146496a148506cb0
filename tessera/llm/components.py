"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (a, b); component is the smallest node reachable.

    Each round links the neighbours below a node to the least of them, then
    moves every link one step up. Both group or join by the lower end's
    own row, and sums are partial, so a node with very many links is no
    single task's work. Rounds grow with the logarithm of the longest path.
    Each round's table is written to the shared folder.
    """
    lower = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v != u").distinct()
    lower = materialize(lower, "links")
    while True:
        least = lower.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
        least = materialize(least, "least")
        several = lower.join(least.where("n > 1"), "v").where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"), F.lit(True).alias("open"))
        # one link from each node, besides those that its other neighbours got; all move up to the least's least
        links = least.select("v", F.col("m").alias("u"), (F.col("n") > 1).alias("open")).unionByName(several)
        up = least.select(F.col("v").alias("u"), F.col("m").alias("up"))
        moved = links.join(up, "u", "left").select("v", F.coalesce("up", "u").alias("u"), (F.col("open") | F.col("up").isNotNull()).alias("open"))
        moved = materialize(moved.groupBy("v", "u").agg(F.max("open").alias("open")), "links")
        if not moved.where("open").limit(1).count():
            return moved.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
                moved.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            )
        lower = moved.select("v", "u")
