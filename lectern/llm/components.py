"""Connected components of a table of links, by alternating star contraction.

Each round points every node at the least node near it; rounds end when the links
are stars.  A node's neighbours are reduced by an aggregate and joined back,
so a node with very many links is never one task's group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import staging


def components(links: DataFrame) -> DataFrame:
    """One row per linked node: node, root (the least node of its component).

    ``links`` has columns a and b of one orderable type; direction, repeats and
    self-links don't matter, nulls link nothing, and no links give no rows.
    """
    edges = staging.stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while edges.take(1):
        # Large star: larger neighbours of a node move to its least neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours move to the least of them.
        lower = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = lower.groupBy("u").agg(F.min("v").alias("m"))
        moved = lower.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = staging.stage(moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        staging.drop(edges)
        edges = new
        # Done when every node points once, at a node that points nowhere: edges lead to lesser nodes, so that is the least.
        side = lambda c, up, down: edges.select(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(down).alias("down"))  # noqa: B023,E731
        moving = side("u", 1, 0).unionByName(side("v", 0, 1)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
        if not moving.take(1):
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    return staging.stage(found, "roots")
