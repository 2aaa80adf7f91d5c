"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v, longs); component: the least node that can be reached.

    Loops and repeated edges are allowed, edges with a null end are dropped. Each round is written to shared storage, so
    nothing is recomputed when an executor is lost, and the former round is deleted. The least neighbour is aggregated
    map-side; the join that gives it back to a hub's edges is one that Spark splits when it is skewed.
    Raises if ``max_rounds`` do not suffice (the number needed grows with the logarithm of the longest path).
    """
    pairs = edges.where(F.col("u") != F.col("v"))
    current = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        moved = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(current)
        current = after
        roots = current.select(F.col("v").alias("u")).distinct()
        links = current.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("d")).first()
        if links["n"] == links["d"] and not current.join(roots, "u", "left_semi").take(1):
            stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
