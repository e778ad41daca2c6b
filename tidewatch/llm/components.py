"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import keep


def _least(edges: DataFrame) -> DataFrame:
    """The smallest lower neighbour of each node that has one. Written, so that a join with it may split hot nodes."""
    return keep(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")), "least")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that isn't the smallest of its component; ``edges`` has (a, b).

    Each round is two joins over the edges that are left; the number of rounds
    grows with the logarithm of the longest chain. The rounds end when the edges
    are stars: each node has one lower neighbour, which has none itself. Only
    counts reach the driver.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = keep(edges, "edges")
    while True:
        least = _least(edges)
        deeper = least.join(least.select(F.col("node").alias("least")), "least", "left_semi")
        if edges.count() == least.count() and deeper.isEmpty():
            return least.select("node", F.col("least").alias("root"))
        large = (
            edges.join(least, F.col("lo") == F.col("node"), "left")
            .select("hi", F.coalesce("least", "lo").alias("lo"))
            .distinct()
        )
        large = keep(large, "large-star")
        joined = large.join(_least(large), F.col("hi") == F.col("node"))
        small = joined.select("hi", F.col("least").alias("lo")).unionByName(
            joined.filter("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        )
        edges = keep(small.distinct(), "edges")
