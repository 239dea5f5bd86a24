"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, loose


def _star(links: DataFrame, lowest: DataFrame) -> DataFrame:
    return links.join(lowest.select(loose("u"), "m"), "u")


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, root) for every node that isn't the smallest of its component; root is the smallest.

    Links may repeat, point either way or from a node to itself; nulls link nothing. A node that is
    missing from the result is its own root. Each round rewrites links to point at smaller nodes,
    and the number of rounds grows with the logarithm of the longest path. Links never reach the
    driver, only their count and checksum.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    now = cut(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _star(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(large, low).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
