"""From raw rows to dimensions and a validated fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_metric_dim(raw: DataFrame) -> DataFrame:
    """One row per (indicator_code, subsection), a null subsection being a key: its first name, unit and section, and a
    dense metric_id in key order. Only the distinct keys are ordered in one task."""
    first = raw.groupBy("indicator_code", "subsection").agg(F.min(F.struct("indicator_name", "indicator_unit", "section")).alias("f"))
    order = Window.orderBy("indicator_code", F.col("subsection").asc_nulls_first())
    return first.select(F.row_number().over(order).cast("long").alias("metric_id"), "indicator_code", "subsection", F.col("f.indicator_name").alias("metric_name"), F.col("f.indicator_unit").alias("unit"), F.col("f.section").alias("section"))


def attach_metric_id(raw: DataFrame, dim: DataFrame) -> DataFrame:
    """``raw`` with metric_id by a null-safe join; null where the dimension lacks the key."""
    d = dim.select(F.col("indicator_code").alias("_c"), F.col("subsection").alias("_s"), "metric_id")
    return raw.join(d, raw.indicator_code.eqNullSafe(d["_c"]) & raw.subsection.eqNullSafe(d["_s"]), "left").drop("_c", "_s")


def split_by_level(raw: DataFrame, levels: tuple[str, ...]) -> dict[str, DataFrame]:
    """A slice per level; rows of other levels are in none."""
    return {level: raw.where(F.col("object_level") == level) for level in levels}


def level_counts(raw: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """Rows per level, and whether it has a slice."""
    return raw.groupBy("object_level").agg(F.count("*").alias("rows")).withColumn("known", F.coalesce(F.col("object_level").isin(*levels), F.lit(False)))


def drop_variants(raw: DataFrame, mark: str, name: str = "object_name") -> DataFrame:
    """Rows whose name doesn't hold ``mark``; a null name stays."""
    return raw.where(~F.coalesce(F.col(name), F.lit("")).contains(mark))


def edition_year(source: str) -> Column:
    """The last year 20xx that a source names; 0 without one."""
    years = F.transform(F.regexp_extract_all(F.col(source), F.lit(r"(20\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    return F.coalesce(F.array_max(years), F.lit(0))


def dedup_latest(raw: DataFrame, keys: list[str], value: str = "indicator_value") -> DataFrame:
    """The row of each key of the newest edition, then version (null last), then source and value: an aggregate that is
    combined before the shuffle, not a sort."""
    rest = [c for c in raw.columns if c not in keys]
    rank = F.struct(edition_year("source").alias("e"), F.coalesce("version_date", F.lit("")).alias("v"), F.coalesce("source", F.lit("")).alias("s"), F.coalesce(F.col(value), F.lit(float("-inf"))).alias("x"))
    top = raw.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("r"))
    return top.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*raw.columns)


def dedup_counts(raw: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows kept and removed by ``dedup_latest``."""
    sizes = raw.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("kept"), (F.sum("n") - F.count("*")).alias("removed"))


def variant_kind(name: str, without: str, having: str) -> Column:
    """without, with or none, by the marks in a name; ``without`` is looked for first."""
    return F.when(F.col(name).contains(without), "without").when(F.col(name).contains(having), "with").otherwise("none")


def build_region_dim(raw: DataFrame, districts: DataFrame, without: str, having: str, include: str = "none") -> DataFrame:
    """One row per entity: smallest name and code, variant, district (null if unmapped), and whether it is included:
    plain entities, and variants of kind ``include``."""
    dim = raw.groupBy(F.col("object_okato").alias("entity")).agg(F.min(F.struct("object_name", "object_oktmo")).alias("n"))
    dim = dim.select("entity", F.col("n.object_name").alias("region_name"), F.col("n.object_oktmo").alias("oktmo"))
    dim = dim.withColumn("variant", variant_kind("region_name", without, having)).join(districts, "entity", "left")
    return dim.withColumn("is_variant", F.col("variant") != "none").withColumn("included", F.col("variant").isin("none", include))


def build_fact(raw: DataFrame) -> DataFrame:
    """(entity, metric_id, year, value, source) of raw rows with metric ids."""
    return raw.select(F.col("object_okato").alias("entity"), "metric_id", "year", F.col("indicator_value").alias("value"), "source")


def quality_report(fact: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: rows, metrics, entities, included entities, first and last year."""
    seen = fact.agg(F.count("*").alias("rows"), F.countDistinct("metric_id").alias("metrics"), F.countDistinct("entity").alias("entities"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return seen.crossJoin(regions.agg(F.count_if("included").alias("included")))


def run_etl(raw: DataFrame, districts: DataFrame, level: str, aggregate: str, without: str, having: str) -> dict[str, DataFrame]:
    """metrics, regions and fact of raw rows: one level, no aggregates, newest editions."""
    metrics = build_metric_dim(raw)
    rows = drop_variants(split_by_level(raw, (level,))[level], aggregate)
    latest = dedup_latest(attach_metric_id(rows, metrics), ["object_okato", "metric_id", "year"])
    return {"metrics": metrics, "regions": build_region_dim(rows, districts, without, having), "fact": build_fact(latest)}


def normal_name(name: str) -> Column:
    """A name for matching: lower case, no parentheses, punctuation, or type words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.translate(F.col(name), "Ёё", "Ее")), r"\([^)]*\)", " "), r"[^\p{L}\p{N}]+", " ")
    return F.array_join(F.filter(F.split(F.trim(plain), " "), lambda w: ~w.isin("region", "republic", "city", "of", "the")), " ")


def crosswalk_names(features: DataFrame, dim: DataFrame, overrides: DataFrame) -> DataFrame:
    """``features`` (name, code) to entity: by code, then override (name, entity), then normal name; how it was found."""
    names = dim.groupBy(normal_name("region_name").alias("key")).agg(F.min("entity").alias("by_name"))
    codes = dim.select(F.col("entity").alias("by_code")).distinct()
    over = overrides.select(F.col("name").alias("o_name"), F.col("entity").alias("by_override"))
    rows = features.withColumn("key", normal_name("name")).join(codes, F.col("code") == F.col("by_code"), "left").join(over, F.col("name") == F.col("o_name"), "left").join(names, "key", "left")
    how = F.when(F.col("by_code").isNotNull(), "code").when(F.col("by_override").isNotNull(), "override").when(F.col("by_name").isNotNull(), "name").otherwise("unmatched")
    return rows.select("name", "code", F.coalesce("by_code", "by_override", "by_name").alias("entity"), how.alias("how"))


def uncovered(dim: DataFrame, matched: DataFrame) -> DataFrame:
    """Entities that no feature was matched to."""
    return dim.select("entity", "region_name").join(matched.select("entity"), "entity", "left_anti")
