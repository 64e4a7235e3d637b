"""Guarded arithmetic and statistics as column expressions. Undefined results are null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is null."""
    return F.try_divide(a, b)


def correlation(x: str, y: str) -> Column:
    """Pearson's r of a group; null with zero variance, where ``corr`` raises."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    flat = (F.max(x) == F.min(x)) | (F.max(y) == F.min(y))
    return F.when(~flat, r)


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling to 0..100; 50 where there is no spread."""
    return F.when(high == low, F.lit(50.0) + value * 0).otherwise(100.0 * ratio(value - low, high - low))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles at a fixed scale (without a negative zero), integers as long: results that compare across engines."""
    kinds = dict(df.dtypes)
    cast = {"int": "long", "bigint": "long", "smallint": "long"}
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast(cast[kinds[c]]).alias(c) if kinds[c] in cast else F.col(c) for c in df.columns])
