"""Ranks within groups of any size, in two passes and without a window over a group.

Rows are dealt in ranges of (group, value, tie), so a group that holds most rows lies in many tasks, and each range is
sorted. The first pass leaves every row its number in its range; the counts of the ranges, a row for each range and
group, are summed up before them; a rank is the number in the range plus the sum. Ties are counted in each range and
then over the few ranges that a value spans, so a value that most rows share is not brought together either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.joins import null_safe
from tessella.functions.lineage import checkpoint


def placed(df: DataFrame, value: str, tie: str, *group: str, descending: bool = False, ties: bool = False) -> DataFrame:
    """``df`` with ``_place``, the ordinal rank by ``value`` and then ``tie`` within the group, and ``_of``, its size.

    With ``ties`` also ``_first``, the rank that equal values share, and ``_same``, how many they are. Null values are
    first in ascending and last in descending order; null groups are a group. Equal rows get ranks of their own.
    """
    order = [*group, F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first(), tie]
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpoint(df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    key = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sizes = rows.groupBy(*group, "_part").agg(F.count("*").alias("_size"), F.min("_at").alias("_begin"))
    sizes = sizes.select(*group, "_part", (F.sum("_size").over(key.orderBy("_part")) - F.col("_size") - F.col("_begin") + 1).alias("_move"), F.sum("_size").over(key).alias("_of"))
    rows = null_safe(rows, sizes, [*group, "_part"]).withColumn("_place", F.col("_at") + F.col("_move")).drop("_at", "_move")
    if not ties:
        return rows.drop("_part")
    local = rows.groupBy(*group, value, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_lo"))
    spans = local.groupBy(*group, value).agg(F.sum("_n").alias("_same"), F.min("_lo").alias("_first")).where("_same > 1")
    tied = null_safe(local.select(*group, value, "_part"), spans, [*group, value])
    rows = null_safe(rows, tied, [*group, value, "_part"], "left").drop("_part")
    return rows.withColumn("_first", F.coalesce("_first", "_place")).withColumn("_same", F.coalesce("_same", F.lit(1)).cast("long"))


_HELP = ("_place", "_of", "_first", "_same")


def ordinal(df: DataFrame, name: str, value: str, tie: str, *group: str, descending: bool = True) -> DataFrame:
    """``df`` with ``name``: 1 for the largest value of a group (the smallest, if ascending); nulls last, ties by ``tie``."""
    return placed(df, value, tie, *group, descending=descending).withColumn(name, F.col("_place")).drop(*_HELP)


def average(df: DataFrame, name: str, value: str, tie: str, *group: str) -> DataFrame:
    """``df`` with ``name``: the ascending rank within a group, ties at their mean rank."""
    return placed(df, value, tie, *group, ties=True).withColumn(name, F.col("_first") + (F.col("_same") - 1) / 2).drop(*_HELP)


def shared(df: DataFrame, name: str, size: str, value: str, tie: str, *group: str) -> DataFrame:
    """``df`` with ``name``: the ascending rank within a group that ties share, their first; and the group's ``size``."""
    return placed(df, value, tie, *group, ties=True).withColumn(name, F.col("_first")).withColumn(size, F.col("_of")).drop(*_HELP)


def share_up_to(df: DataFrame, name: str, value: str, tie: str, *group: str) -> DataFrame:
    """``df`` with ``name``: the share of a group's values up to the own one."""
    return placed(df, value, tie, *group, ties=True).withColumn(name, (F.col("_first") + F.col("_same") - 1) / F.col("_of")).drop(*_HELP)
