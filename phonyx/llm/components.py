"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in `edges` (u, v: integers); root is the least node it reaches.

    Large-star and small-star rounds link every node to the least neighbour it
    knows until each component is one star; rounds grow with the logarithm of
    the component's size, edges never multiply, and each round is written to
    the shared folder. Only a count and a checksum come to the driver. Nodes
    without an edge are not in the result; an empty table gives an empty one.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        star = large.join(low, F.col("u") == F.col("c"))
        # Each lower neighbour moves to the least one; the node itself, too.
        moved = star.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(star.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # Edges never multiply.
        old, now = now, materialize(moved, "edges", seen[0])
        discard(old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).groupBy("node").agg(F.min("root").alias("root"))
