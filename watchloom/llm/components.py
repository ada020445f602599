"""Connected components of an edge table by alternating large and small stars.

Every round replaces each edge by one towards the smallest neighbour; the number of edges never
grows, hubs are reduced by aggregates before a join, and each round is a written table, so
lineage stays short and a lost executor costs one round at most. Ends when a round changes
nothing, however deep the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (columns ``a``, ``b`` of one orderable type).

    The root is the smallest node reachable. Loops, repeated edges and edges in either direction
    are allowed; an edge with a null end is ignored; no edges give no rows.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a != b").distinct(), "edges")
    nodes = now.select(F.col("u").alias("node")).union(now.select("v"))
    mark = _mark(now)
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = materialize(small.filter("u != v").distinct(), "stars")
        again = _mark(now)
        if again == mark:
            break
        mark = again
    return nodes.distinct().join(now.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Equal marks: the same set of edges."""
    h = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())
