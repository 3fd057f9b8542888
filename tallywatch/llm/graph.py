"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import stored


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours of every node to the least node around it."""
    if both_ways:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = edges.join(least, "a")
    if both_ways:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link: component is the smallest node that can be reached.

    Alternating large-star and small-star steps; links shrink to one per node, pointing at the
    smallest node of its component. Every round is stored, and the number of rounds grows
    with the logarithm of the longest chain. Nulls and links to oneself are left out.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    edges = stored(edges, "links")
    mark = None
    while True:
        edges = stored(_star(_star(edges, True).where("a != b").distinct(), False).where("a > b").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
