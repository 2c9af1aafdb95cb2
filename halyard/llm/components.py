"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import dropped, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Edges run from larger u to smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of any direction to (node, root): root is the smallest node of its component.

    Nodes without a link to another don't appear. Every round writes its links to
    the shared folder; rounds grow as the logarithm of the longest path. Hot nodes
    are pre-aggregated, and their joins are of a kind that adaptive execution splits.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    while True:
        after = stored(_small_star(_large_star(now).where("u != v").distinct()).distinct(), "links")
        # done once every node has one link and no link's end has a link of its own
        state = after.groupBy("u").agg(F.count("*").alias("n"))
        done = state.where("n > 1").limit(1).count() == 0 and after.join(state.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0
        dropped(now)
        now = after
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
