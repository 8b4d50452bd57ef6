"""Connected components by alternating large and small stars.

Every round is one job over the edges whose result is written to the shared folder, so the lineage
stays short; no node or edge reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sensorlake.session import materialise


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node of ``edges`` (columns ``a, b``); a component is named by
    its smallest node. Loops and repeated edges are allowed; edges with a null end are left out."""
    stars = materialise(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    for _ in range(most_rounds):
        stars = materialise(small_star(large_star(stars)))
        state = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = state
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def large_star(edges: DataFrame) -> DataFrame:
    """Links a node's larger neighbours to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.join(least, "a")
        .filter("b > a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Edges point downwards."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
