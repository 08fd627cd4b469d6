"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a pre-aggregated minimum and a join whose one side has a row a node; a node with many
links, such as the centre of a star, is dealt apart (``split_join``). Every step's links are written to the shared folder, which cuts
the lineage. Labels are never gathered on the driver: only a count and a checksum of the links are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, split_join, stage


def components(links: DataFrame) -> DataFrame:
    """``links``: (a, b) of any comparable type. One row per node but the smallest of each component: (node, root)."""
    ordered = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stage(ordered, "links")
    seen = _mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(0).alias("low")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v"), F.lit(1).alias("low")))
        least = both.groupBy("u").agg(F.min("v").alias("v"), F.sum("low").alias("n")).filter("n > 0")
        least = stage(least.select(F.col("u").alias("b"), F.least("u", "v").alias("m"), "n"), "least")
        large = stage(split_join(now, least, ["b"]).select("a", F.col("m").alias("b")).distinct(), "large")
        lows = stage(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "lows")
        down = split_join(large, lows, ["a"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = stage(down.union(lows.select("a", F.col("m").alias("b"))).distinct(), "small")
        for old in (least, large, lows, now):
            release(old)
        now, before, seen = small, seen, _mark(small)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
