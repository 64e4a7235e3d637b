"""Exact quantiles of all groups at once, by histograms that are refined where a quantile lies.

A quantile is one or two values of known rank. The first histogram of a group counts values by sign and binary exponent,
each further one cuts the bucket that holds the rank into ``buckets`` equal steps between its smallest and largest value.
Counts are combined before they are shuffled, so a group of any size is a few rows a task; values themselves reach a
task only from a bucket of at most ``limit`` values. A bucket of one value ends the search, as with ties and constants.
The exponent fixes the values up to a factor of two and a round divides their range by ``buckets``, so that the 52 bits
of a fraction take six rounds at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.joins import null_safe, with_small
from tessella.functions.lineage import checkpoint


def _exponent(v: Column) -> Column:
    """A number that doesn't fall as v rises: sign and binary exponent; infinities and NaN have their own."""
    size = F.floor(F.log2(F.abs(v))) + 2000
    code = F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)
    return F.when(F.isnan(v), 9001).when(v == float("inf"), 9000).when(v == float("-inf"), -9000).otherwise(code)


def _inside(rows: DataFrame, sought: DataFrame, group: list[str]) -> DataFrame:
    """The values within the intervals of ``sought``, which are equal or disjoint in a group, each with its interval ``_i``."""
    each = sought.select(*group, "_lo", "_hi").distinct().groupBy(*group).agg(F.collect_list(F.struct("_lo", "_hi")).alias("_each"))
    held = with_small(rows, each, group).withColumn("_i", F.get(F.filter("_each", lambda i: F.col("_v").between(i["_lo"], i["_hi"])), F.lit(0)))
    return held.where("_i is not null").select(*group, "_v", "_i._lo", "_i._hi")


def _refined(rows: DataFrame, sought: DataFrame, group: list[str], bucket: Column) -> DataFrame:
    """``sought`` (group, _k, _lo, _hi, _below, _n) with the smaller interval that holds the value of rank ``_k``."""
    counts = _inside(rows, sought, group).groupBy(*group, "_lo", bucket.alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_l"), F.max("_v").alias("_h"))
    found = null_safe(sought, counts, [*group, "_lo"])
    order = Window.partitionBy(*group, "_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("_before", F.col("_below") + F.sum("_c").over(order) - F.col("_c")).where((F.col("_before") <= F.col("_k")) & (F.col("_k") < F.col("_before") + F.col("_c")))
    return found.select(*group, "_k", F.col("_l").alias("_lo"), F.col("_h").alias("_hi"), F.col("_before").alias("_below"), F.col("_c").alias("_n"))


def _values_at(rows: DataFrame, sought: DataFrame, group: list[str], limit: int, buckets: int) -> DataFrame:
    """(group, _k, _x): the value of each rank sought, counted from 0."""
    done, bucket = [], _exponent(F.col("_v"))
    while True:
        open_ = (F.col("_n") > limit) & (F.col("_lo") < F.col("_hi"))
        done.append(sought.where(~open_))
        sought = sought.where(open_)
        if sought.isEmpty():
            break
        sought = checkpoint(_refined(rows, sought, group, bucket))
        bucket = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets)
    ready = reduce(DataFrame.unionByName, done)
    last = ready.where("_lo < _hi")
    lists = _inside(rows, last, group).groupBy(*group, "_lo").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    picked = null_safe(last, lists, [*group, "_lo"]).select(*group, "_k", F.element_at("_all", (F.col("_k") - F.col("_below") + 1).cast("int")).alias("_x"))
    return ready.where("not (_lo < _hi)").select(*group, "_k", F.col("_lo").alias("_x")).unionByName(picked)


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float], limit: int = 4096, buckets: int = 1024) -> DataFrame:
    """``group`` and a column for each name of ``shares``: that share's quantile of the group, linear between two values.

    Equal to ``percentile``. Null values don't count, and a group without others has no row; null groups are a group.
    Groups of at most ``limit`` values are left to ``percentile`` itself.
    """
    rows = checkpoint(df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v")))
    sizes = checkpoint(rows.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    named = list(shares.items())
    direct = lambda own: own.groupBy(*group).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for _, p in named])).alias("_q")).select(*group, *[F.col("_q")[k].alias(n) for k, (n, _) in enumerate(named)])
    large = sizes.where(F.col("_n") > limit)
    if large.isEmpty():
        return direct(rows)
    at = {n: F.col("_n") * 0 + (F.col("_n") - 1) * F.lit(float(p)) for n, p in named}
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil)]))
    sought = large.select(*group, F.explode(ranks).alias("_k"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), "_n")
    own = with_small(rows, large.select(*group), group, "left_semi")
    found = _values_at(own, sought, group, limit, buckets).groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_x"))).alias("_m"))
    rows_of = null_safe(large, found, group)
    out = []
    for n, p in at.items():
        low, high = F.col("_m")[F.floor(p).cast("long")], F.col("_m")[F.ceil(p).cast("long")]
        out.append(F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(n))
    return direct(with_small(rows, large.select(*group), group, "left_anti")).unionByName(rows_of.select(*group, *out))
