"""Connected components of a link table, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keepwell.session import settle


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link to a smaller or larger one.

    ``links`` has u and v of one orderable type. Each round hangs the larger
    neighbours of a node below its smallest neighbour, then the smaller ones; the
    links become stars in a number of rounds that grows with the logarithm of their
    longest path. Every round is written, so a lost executor costs one round.
    """
    now = settle(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .where("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(least, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .unionByName(least.select("u", F.col("low").alias("v"))).distinct())
        now = settle(small, "links")
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
    raise RuntimeError("components did not settle")
