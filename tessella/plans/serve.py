"""Serving queries over the derived tables: filters, names, order and limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def serve(table: DataFrame, filters: dict | None = None, names: list[tuple[DataFrame, str, list[str]]] = (), order: list = (), limit: int | None = None) -> DataFrame:
    """``table`` where each column of ``filters`` (None: no filter; a list: any; a pair of bounds as a tuple: between)
    matches, with columns of other tables left-joined by key, ordered and limited."""
    for column, value in (filters or {}).items():
        if value is None:
            continue
        c = F.col(column)
        table = table.where(c.isin(*value) if isinstance(value, list) else c.between(*value) if isinstance(value, tuple) else c == value)
    for other, key, columns in names:
        table = table.join(other.select(key, *columns), key, "left")
    table = table.orderBy(*order) if order else table
    return table.limit(limit) if limit else table


def search(table: DataFrame, name: str, text: str, order: list, limit: int) -> DataFrame:
    """Rows whose name holds ``text`` in any case."""
    return table.where(F.lower(name).contains(text.lower())).orderBy(*order).limit(limit)


def metric_series(fact: DataFrame, features: DataFrame, entity: str, metric: int, years: tuple[int, int] | None = None) -> DataFrame:
    """Raw and harmonised values of an entity's metric by year."""
    rows = serve(fact, {"entity": entity, "metric_id": metric, "year": years})
    extra = features.select("entity", "metric_id", "year", "value_harmonized", "is_imputed")
    return rows.join(extra, ["entity", "metric_id", "year"], "left").select("year", "value", "value_harmonized", "is_imputed").orderBy("year")


def cross_section(fact: DataFrame, regions: DataFrame, metric: int, year: int) -> DataFrame:
    """Included entities by a metric's value in a year."""
    rows = serve(fact, {"metric_id": metric, "year": year}).where("value is not null")
    return rows.join(regions.where("included").select("entity", "region_name"), "entity").select("entity", "region_name", "value").orderBy(F.col("value").desc(), "entity")


def compare_entities(dev: DataFrame, clusters: DataFrame, regions: DataFrame, entities: list[str], year: int, scheme: str) -> DataFrame:
    """Scores and cluster of chosen entities."""
    rows = serve(dev, {"entity": entities, "year": year, "scheme": scheme}).join(regions.select("entity", "region_name"), "entity")
    return rows.join(clusters, ["entity", "year"], "left")


def catalog_list(catalog: DataFrame, tier: str | None = None, domain: str | None = None, name: str | None = None, limit: int = 100) -> DataFrame:
    """The catalogue: core, extended, sparse, each by coverage."""
    rows = serve(catalog, {"tier": tier, "domain": domain})
    rows = rows.where(F.lower("metric_name").contains(name.lower())) if name else rows
    key: Column = F.when(F.col("tier") == "core", 0).when(F.col("tier") == "extended", 1).otherwise(2)
    return rows.orderBy(key, F.col("coverage").desc(), "metric_id").limit(limit)


def freshness(fact: DataFrame, regions: DataFrame, dev: DataFrame) -> DataFrame:
    """One row: last year of facts, included entities, last year of the index."""
    rows = fact.agg(F.max("year").alias("last_year")).crossJoin(regions.agg(F.count_if("included").alias("included")))
    return rows.crossJoin(dev.agg(F.max("year").alias("index_year")))
