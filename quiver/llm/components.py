"""Connected components of links, by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import materialise


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Component (smallest id) of every node of the links (a, b): node, component.

    Each round hangs every node below the smallest neighbour, once for larger and once for smaller neighbours; the
    rounds needed grow as the logarithm of the longest chain. Every round is written to the shared folder. No list of
    neighbours is ever built, so a hub of any degree is only rows of a join.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct()
    before = None
    for at in range(most_rounds):
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(root.select("hi", "m"))
        edges = materialise(small.distinct(), f"star{at}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
