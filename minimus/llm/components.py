"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """Staged (node, root) for every node of ``links`` (u, v: longs); root is the smallest
    node of the component. Each round connects the neighbours of a node to their
    smallest member (first the larger ones, then the smaller ones), which needs two
    shuffles of the links and about log(longest path) rounds. A node's neighbours meet
    only in aggregates and joins, never in one row."""
    edges = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .where("u <> v").distinct(), "links")
    before = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = stage(small, "stars")
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stage(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
