"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two joins on a node's least neighbour and is written to the shared folder, so lost
executors cost one round at most. The number of rounds grows with the logarithm of the longest
path. A node with very many links is a hot key of a plain join, whose large side Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage, release


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a long, b long); component: the least node."""
    spark = links.sparkSession
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges = cut_lineage(spark, edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        starred = _star(spark, both, True)
        release(edges)
        edges = _star(spark, starred, False)
        release(starred)
        # Two numbers for the whole table.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _star(spark, edges: DataFrame, large: bool) -> DataFrame:
    """Link each neighbour of a node, above it (``large``) or below it, to the least of all.

    For the large star ``edges`` holds both directions; for the small one a > b.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    least = cut_lineage(spark, least, "least-neighbours")
    joined = edges.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    moved = moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    out = cut_lineage(spark, moved.distinct(), "links")
    release(least)
    return out
