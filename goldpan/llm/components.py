"""Connected components of links, as joins that repeat until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.sources.storage import cut_lineage


def _mark(stars: DataFrame) -> tuple:
    return tuple(
        stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``links`` (a, b).

    Large-star and small-star turns (Kiveris and others, 2014): each turn links every
    node's larger, then smaller neighbours to its smallest one. Chains shorten at least by
    half in a turn, and a turn never makes more links than there are. Nothing is
    collected per node: a node of many links is an aggregate and a splittable join.
    Roots themselves are not listed; no links give no rows.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    stars = cut_lineage(links.where("a <> b").select(a.alias("a"), b.alias("b")).distinct())
    mark = _mark(stars)
    while mark[0]:
        back = stars.select(F.col("b").alias("a"), F.col("a").alias("b"))
        near = stars.unionByName(back)
        lowest = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            near.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        ).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        rest = large.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        stars = cut_lineage(rest.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        before, mark = mark, _mark(stars)
        if before == mark:
            break
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
