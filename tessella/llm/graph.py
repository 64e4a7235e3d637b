"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Tables, width

#: Edges that one partition takes at least; the stars of a small graph then need no shuffle.
SHARE = 1 << 15


def _large_star(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    both = edges.select(F.explode(ends).alias("x")).select("x.u", "x.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that it reaches.

    Both steps are grouped minima and joins, so a node of many edges is combined before the shuffle; AQE splits
    what is left of it. Loops and nulls are ignored, no edges give no rows. Each round is written as a table and the
    one before it dropped, spread over as many partitions as its edges need; only a count and checksums of the edges
    come to the driver.
    """
    spark = edges.sparkSession
    tables = Tables(spark)
    now = tables.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % (1 << 30))).first()
        if mark == seen or not mark[0]:
            break
        seen, parts = mark, -(-mark[0] // SHARE)
        new = tables.put(_small_star(_large_star(now.coalesce(parts) if parts < width(spark) else now)))
        tables.drop(now)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
