"""Ranks in two passes and refined quantiles against windows and numpy, on ties, constants, nulls and hot groups."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import joins, quantiles, ranking

KIND = "g string, h long, e string, v double"


@pytest.fixture(scope="module")
def rows(spark):
    """A group with most rows, half of them equal; small groups, one of a single row, one constant, null groups and values."""
    rng = np.random.default_rng(1)
    found = [("hot", 1, f"e{k:05d}", 7.0 if k % 2 else float(rng.normal())) for k in range(4000)]
    found += [("b", k % 3, f"e{k:03d}", float(rng.integers(0, 6))) for k in range(300)]
    found += [("one", 1, "x", 2.0)] + [("same", 2, f"e{k}", 3.0) for k in range(40)] + [(None, 1, f"e{k}", float(k % 5)) for k in range(30)] + [(None, None, f"e{k}", -float(k)) for k in range(9)]
    found += [("b", 0, f"n{k}", None) for k in range(7)]
    return spark.createDataFrame(found, KIND).repartition(6).cache()


def table(df, *columns):
    return sorted(tuple(r) for r in df.select(F.coalesce("g", F.lit("-")), F.coalesce("h", F.lit(-1)), "e", *columns).collect())


def test_ranks_are_those_of_windows(rows):
    key = Window.partitionBy("g", "h")
    up = key.orderBy(F.col("v").asc_nulls_first())
    want = rows.withColumn("r", F.row_number().over(key.orderBy(F.col("v").desc_nulls_last(), "e")).cast("long"))
    assert table(ranking.ordinal(rows, "r", "v", "e", "g", "h"), "r") == table(want, "r")
    want = rows.withColumn("r", F.row_number().over(key.orderBy(F.col("v").asc_nulls_first(), "e")).cast("long"))
    assert table(ranking.ordinal(rows, "r", "v", "e", "g", "h", descending=False), "r") == table(want, "r")
    same = F.count("*").over(Window.partitionBy("g", "h", "v"))
    assert table(ranking.average(rows, "r", "v", "e", "g", "h"), "r") == table(rows.withColumn("r", F.rank().over(up) + (same - 1) / 2), "r")
    want = rows.withColumn("r", F.rank().over(up).cast("long")).withColumn("n", F.count("*").over(key))
    assert table(ranking.shared(rows, "r", "n", "v", "e", "g", "h"), "r", "n") == table(want, "r", "n")
    assert table(ranking.share_up_to(rows, "r", "v", "e", "g", "h"), "r") == table(rows.withColumn("r", F.cume_dist().over(up)), "r")


def test_ranks_without_a_group_and_without_rows(spark, rows):
    some = rows.where("g = 'b' and v is not null").select("g", "h", F.concat("e", F.lit("|"), F.col("h")).alias("e"), "v")
    want = some.withColumn("r", F.row_number().over(Window.orderBy(F.col("v").desc(), "e")).cast("long"))
    assert table(ranking.ordinal(some, "r", "v", "e"), "r") == table(want, "r")
    assert ranking.average(spark.createDataFrame([], KIND), "r", "v", "e", "g").count() == 0


def test_no_task_ranks_a_whole_group(rows):
    """The plan has windows over the counts of ranges alone, and the hot group lies in several ranges."""
    spread = rows.where("g = 'hot'").repartitionByRange(8, "g", "v", "e").groupBy(F.spark_partition_id()).count()
    assert spread.count() >= 7 and spread.agg(F.max("count")).first()[0] < 1500
    plan = ranking.average(rows, "r", "v", "e", "g", "h")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 2 and "rank(" not in plan and "row_number(" not in plan


SHARES = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def close(a, b):
    return a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-15)))


@pytest.mark.parametrize(("limit", "buckets"), [(3, 1024), (60, 64), (100_000, 1024)])
def test_quantiles_are_those_of_percentile(rows, limit, buckets):
    want = rows.where("v is not null").groupBy("g", "h").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in SHARES.items()])
    key = lambda r: (str(r.g), str(r.h))
    got = sorted(quantiles.quantiles(rows, ["g", "h"], "v", SHARES, limit, buckets).collect(), key=key)
    want = sorted(want.collect(), key=key)
    assert len(got) == len(want) == 8
    for g, w in zip(got, want, strict=True):
        assert (g.g, g.h) == (w.g, w.h) and all(close(g[n], w[n]) for n in SHARES), (g, w)


def test_quantiles_of_wild_values(spark):
    """Signs, 600 orders of magnitude, neighbouring doubles, infinities and NaN."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), 1e6 + np.arange(300) * 1.2e-10, [0.0, -0.0, 5e-324, -5e-324, np.inf, np.inf, -np.inf, np.nan]])
    rows = spark.createDataFrame([(float(v),) for v in rng.permutation(x)], "v double")
    shares = {f"q{k}": k / 40 for k in range(41)}
    want = rows.agg(F.percentile("v", F.array(*[F.lit(p) for p in shares.values()]))).first()[0]
    got = quantiles.quantiles(rows.withColumn("g", F.lit(1)), ["g"], "v", shares, 2, 1024).first()
    assert all(close(got[n], w) for n, w in zip(shares, want, strict=True))
    assert quantiles.quantiles(rows.where("false").withColumn("g", F.lit(1)), ["g"], "v", shares).count() == 0


def test_a_side_too_large_is_not_broadcast(rows):
    small = rows.groupBy("g").count()
    plans = [joins.with_small(rows, small, ["g"], most=m)._jdf.queryExecution().optimizedPlan().toString() for m in (1, 100)]
    assert "broadcast" not in plans[0] and "broadcast" in plans[1]
    assert joins.with_small(rows, small, ["g"], most=1).count() == rows.count()
