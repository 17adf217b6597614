"""Connected components of a graph whose edges are rows, by alternating star contractions.

Each round lets every node point its larger neighbours at its smallest
neighbour (large star), then does so for the smaller ones (small star).  The
number of rounds grows with the logarithm of the component size, and no round
gathers a node's neighbours: minima are partial aggregates, and neighbours meet
them in an ordinary join, which adaptive execution splits where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import keep


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` to ``(node, component)``: the smallest node that can be reached.

    Directions, repeated edges, loops and edges with a null end do not matter.
    Nodes without an edge to another node are not returned.
    """
    stars = keep(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = _fingerprint(stars)
    while seen[0]:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )  # every edge (u, v) has v < u again
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = keep(moved.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        now = _fingerprint(stars)
        if now == seen:
            break
        seen = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
