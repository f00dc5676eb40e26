"""Connected components of links between records, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that links reach, for every node with a link.

    ``edges`` has a and b. Large and small star steps alternate; each hooks
    neighbours onto the smallest neighbour, and a few rounds suffice for any shape.
    Every round is written to the shared folder, so plans stay short. Only a
    count and a checksum come to the driver. A hub's links meet in a join, which
    Spark splits, and in a minimum, which combines before the shuffle.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    e = materialize(e, "links")
    seen = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        last, e = e, materialize(small, "links")
        release(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    stars = e.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
