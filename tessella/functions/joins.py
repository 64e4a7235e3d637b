"""Joins on keys that may be null, and joins whose smaller side is broadcast only when its counted size allows it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` in which nulls are equal; the keys come once, from ``left``."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.lit(True))
    joined = left.join(named, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def with_small(left: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", most: int = 100_000) -> DataFrame:
    """``null_safe`` with a side that is usually small: broadcast if it has at most ``most`` rows, else shuffled."""
    return null_safe(left, F.broadcast(small) if small.limit(most + 1).count() <= most else small, keys, how)
