"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, release


def _to_least(near: DataFrame, larger_only: bool) -> DataFrame:
    """near: (u, v), each link in the directions that count. Joins every u's neighbours to the least of u and them."""
    least = near.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", F.least("w", "m"))
    linked = near.join(least, F.col("u") == F.col("w"))
    if larger_only:
        return linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("w").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """links: (a, b), two columns of one comparable type. Returns node, component (the least node reachable) for every node of a link.

    Large-star and small-star steps alternate until nothing changes; every step is a group-by and a join on the node, written to the shared
    folder, so neither the driver nor a task ever holds a component. The rounds grow with the logarithm of the longest path; the table of a
    round goes when the next one is written.
    """
    links = links.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = materialise(links, "links"), None
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        stars = _to_least(both, True).where("a <> b").distinct()
        down = stars.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        after = materialise(_to_least(down, False).where("a <> b").distinct(), "links")
        release(links)
        links = after
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
