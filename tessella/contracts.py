"""Schemas of the panel tables and the checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TEXT = "section indicator_code indicator_name subsection object_name object_level object_oktmo object_okato".split()
#: The columns of a raw long file, in order.
CANONICAL = {c: "string" for c in _TEXT} | {"year": "long", "indicator_value": "double"} | {c: "string" for c in ("indicator_unit", "comment", "source", "version_date")}
ANOMALIES = {"kind": "string", "entity": "string", "metric_id": "long", "year": "long", "score": "double"}
DEV_INDEX = {"entity": "string", "year": "long", "scheme": "string", "total_score": "double"}


def enforce(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly the columns of ``schema``, in its order and types; a missing one is an error that names all of them."""
    missing = [c for c in schema if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in schema.items()])


def fact_faults(fact: DataFrame, first: int = 1900, last: int = 2100) -> DataFrame:
    """One row: rows, null keys, years out of range, and keys (entity, metric_id, year) that occur more than once."""
    counts = fact.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("entity").isNull() | F.col("metric_id").isNull() | F.col("year").isNull()).alias("null_keys"),
        F.count_if(~F.col("year").between(first, last)).alias("bad_years"),
    )
    twice = fact.groupBy("entity", "metric_id", "year").count().where("count > 1").agg(F.count("*").alias("duplicate_keys"))
    return counts.crossJoin(twice)


def validate_fact(fact: DataFrame, first: int = 1900, last: int = 2100) -> DataFrame:
    """``fact``, if it has no fault; an error with the counts otherwise."""
    found = fact_faults(fact, first, last).first().asDict()
    if any(found[k] for k in ("null_keys", "bad_years", "duplicate_keys")):
        raise ValueError(f"invalid fact: {found}")
    return fact
