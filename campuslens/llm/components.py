"""Connected components on tables of links (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, forget


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node of the links (a, b).

    Each round points neighbours at their smallest neighbour, first from
    above, then from below; the links end as stars.  Rounds read the
    stored links of the round before, in ``scratch``.  Links with a null end are ignored.
    """
    edges = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = scratch.saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        pairs = edges.join(low, "u")
        edges = scratch.saved(pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .union(low.select("u", "m")).distinct(), "links")
        forget(scratch.spark)  # the driver's heap, too: a round leaves plans and broadcasts behind
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct())
        seen = now
