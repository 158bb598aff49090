"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, in which the links of a node are dealt into
SALTS parts, so that the middle of a giant component is not one task's; nothing is
collected and no group is held in memory. Each round's links are written to the shared folder, so a lost executor costs
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.scratch import Scratch

SALTS = 8


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a > b) -> each neighbour of a node linked to the smallest of its neighbours and itself."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    parts = least.select(F.col("a").alias("of"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    met = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(parts, (F.col("a") == F.col("of")) & (F.col("salt") == F.col("part")))
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links of any order -> (node, component): the smallest node reachable, for nodes other than it."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = scratch.save(links, "links")
    state = None
    while True:
        after = scratch.save(_star(_star(links, True), False), "star")
        n, total = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(links)
        links = after
        if (n, total) == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = (n, total)
