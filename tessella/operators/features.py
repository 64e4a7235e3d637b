"""From a sparse fact table to a dense, imputed, standardised panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.config import VALUE_TYPES, PanelConfig
from tessella.functions.lineage import checkpoint
from tessella.functions.joins import null_safe
from tessella.functions.quantiles import quantiles
from tessella.functions.stats import ratio


def classify_value_type(unit: str, rules=VALUE_TYPES, default: str = "absolute", nodata: str = "ND") -> Column:
    """The type of the first rule whose words a unit holds, in any case; null and ``nodata`` are the default."""
    out = F.when(F.col(unit).isNull() | (F.trim(unit) == nodata), default)
    for mark, kind in rules:
        out = out.when(F.lower(unit).contains(mark), kind)
    return out.otherwise(default)


def compute_coverage(fact: DataFrame, regions: DataFrame, years: tuple[int, int]) -> DataFrame:
    """The share of (included entity, year of the window) cells that a metric has a value for; no such cells are an error."""
    included = regions.where("included").select("entity").distinct()
    if years[1] < years[0] or included.isEmpty():
        raise ValueError("no included entity and year to cover")
    cells = fact.where(F.col("value").isNotNull() & F.col("year").between(*years)).join(included, "entity", "left_semi")
    found = cells.groupBy("metric_id").agg(F.countDistinct("entity", "year").alias("cells"))
    size = included.agg((F.count("*") * (years[1] - years[0] + 1)).alias("size"))
    return found.crossJoin(F.broadcast(size)).select("metric_id", "cells", (F.col("cells") / F.col("size")).alias("coverage"))


def enrich_metric_dim(metrics: DataFrame, core: DataFrame, domains: DataFrame, coverage: DataFrame, default: str = "other") -> DataFrame:
    """Metrics with domain, value type, direction and coverage; ``core`` (metric_id, domain, value_type, higher_is_better)
    goes before the section's domain and the unit's type. Off the core the direction is null; no coverage is 0."""
    c = core.select("metric_id", F.col("domain").alias("c_domain"), F.col("value_type").alias("c_type"), "higher_is_better")
    rows = metrics.join(c, "metric_id", "left").join(domains.select("section", F.col("domain").alias("s_domain")), "section", "left").join(coverage.select("metric_id", "coverage"), "metric_id", "left")
    return rows.select(
        "metric_id", "metric_name", F.coalesce("c_domain", "s_domain", F.lit(default)).alias("domain"), F.coalesce("c_type", classify_value_type("unit")).alias("value_type"),
        "higher_is_better", F.col("c_domain").isNotNull().alias("is_core"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def harmonize(fact: DataFrame, metrics: DataFrame, population: int) -> DataFrame:
    """``fact`` with value_harmonized: absolute values by the population of entity and year, if that is positive."""
    people = fact.where(F.col("metric_id") == population).select("entity", "year", F.col("value").alias("people"))
    kinds = metrics.select("metric_id", "value_type")
    rows = fact.join(kinds, "metric_id", "left").join(people, ["entity", "year"], "left")
    value = F.when(F.col("value_type") == "absolute", F.when(F.col("people") > 0, ratio(F.col("value"), F.col("people")))).otherwise(F.col("value"))
    return rows.select("entity", "metric_id", "year", value.alias("value_harmonized"))


def core_below_coverage(metrics: DataFrame, least: float) -> DataFrame:
    """Core metrics whose coverage is too small; they are reported, not dropped."""
    return metrics.where(F.col("is_core") & (F.col("coverage") < least)).select("metric_id", "metric_name", "coverage")


def core_fact(harmonized: DataFrame, metrics: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Rows of core metrics in the window."""
    return harmonized.where(F.col("year").between(*years)).join(metrics.where("is_core").select("metric_id"), "metric_id", "left_semi")


def build_long_grid(core: DataFrame, regions: DataFrame, metrics: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Every (included entity, core metric, year) with its value or null. Years and metrics are exploded, not joined."""
    ids = metrics.where("is_core").select("metric_id").distinct()
    cells = regions.where("included").select("entity").distinct().crossJoin(ids).withColumn("year", F.explode(F.sequence(F.lit(years[0]).cast("long"), F.lit(years[1]).cast("long"))))
    return cells.join(core, ["entity", "metric_id", "year"], "left").select("entity", "metric_id", "year", "value_harmonized")


def interpolate_gaps(grid: DataFrame, max_gap: int) -> DataFrame:
    """Linear interpolation by position of inner gaps of at most ``max_gap`` years; ``filled`` is the new value."""
    series = Window.partitionBy("entity", "metric_id").orderBy("year")
    back, ahead = series.rowsBetween(Window.unboundedPreceding, 0), series.rowsBetween(0, Window.unboundedFollowing)
    v = F.col("value_harmonized")
    at = F.when(v.isNotNull(), F.col("i"))
    rows = grid.withColumn("i", F.row_number().over(series))
    rows = rows.withColumn("v0", F.last(v, True).over(back)).withColumn("i0", F.last(at, True).over(back)).withColumn("v1", F.first(v, True).over(ahead)).withColumn("i1", F.first(at, True).over(ahead))
    inner = F.col("v0") + (F.col("v1") - F.col("v0")) * ratio(F.col("i") - F.col("i0"), F.col("i1") - F.col("i0"))
    filled = F.when(v.isNotNull(), v).when(F.col("i1") - F.col("i0") - 1 <= max_gap, inner)
    return rows.select("entity", "metric_id", "year", "value_harmonized", filled.alias("filled"))


def impute_features(grid: DataFrame, max_gap: int) -> DataFrame:
    """Interpolation, then the median of (metric, year), then of the metric; ``is_imputed`` tells what was null."""
    rows = checkpoint(interpolate_gaps(grid, max_gap))
    by_year = quantiles(rows, ["metric_id", "year"], "filled", {"m": 0.5})
    rows = checkpoint(null_safe(rows, by_year, ["metric_id", "year"], "left").withColumn("filled", F.coalesce("filled", "m")).drop("m"))
    overall = quantiles(rows, ["metric_id"], "filled", {"m": 0.5})
    rows = null_safe(rows, overall, ["metric_id"], "left").withColumn("filled", F.coalesce("filled", "m"))
    return rows.select("entity", "metric_id", "year", F.col("filled").alias("value_harmonized"), F.col("value_harmonized").isNull().alias("is_imputed"))


def imputation_gate(features: DataFrame, share_max: float) -> DataFrame:
    """One row: cells, imputed cells, cells still null, and whether the gate holds."""
    seen = features.agg(F.count("*").alias("cells"), F.count_if("is_imputed").alias("imputed"), F.count_if(F.col("value_harmonized").isNull()).alias("still_null"))
    return seen.withColumn("ok", (F.col("imputed") <= share_max * F.col("cells")) & (F.col("still_null") == 0))


def add_zscore(features: DataFrame) -> DataFrame:
    """``z_value`` by (metric, year) with the sample deviation; 0 where that is null or 0."""
    stats = features.groupBy("metric_id", "year").agg(F.avg("value_harmonized").alias("mean"), F.stddev_samp("value_harmonized").alias("sd"), (F.max("value_harmonized") == F.min("value_harmonized")).alias("flat"))
    z = F.when(F.col("sd").isNull() | (F.col("sd") == 0) | F.col("flat"), 0.0).otherwise(ratio(F.col("value_harmonized") - F.col("mean"), F.col("sd")))
    return features.join(stats, ["metric_id", "year"]).select("entity", "metric_id", "year", "value_harmonized", z.alias("z_value"), "is_imputed")


def run_features(fact: DataFrame, regions: DataFrame, metrics: DataFrame, population: int, years: tuple[int, int], config: PanelConfig = PanelConfig(), gate: bool = False) -> DataFrame:
    """The dense panel: harmonised, gridded, imputed and standardised. With ``gate`` a failed imputation is an error."""
    grid = build_long_grid(core_fact(harmonize(fact, metrics, population), metrics, years), regions, metrics, years)
    done = impute_features(grid, config.max_gap)
    if gate and not imputation_gate(done, config.share_max).first().ok:
        raise ValueError("too many imputed or null cells")
    return add_zscore(done)


def profile_matrix(features: DataFrame, metric_ids: list[int]) -> DataFrame:
    """One row per (entity, year), a column per metric in numeric order; the fixed list saves a job."""
    wide = features.groupBy("entity", "year").pivot("metric_id", sorted(metric_ids)).agg(F.first("z_value"))
    return wide.select("entity", "year", *[F.col(str(m)).alias(f"m{m}") for m in sorted(metric_ids)])


def profile_vector(features: DataFrame) -> DataFrame:
    """(entity, year, profile): the z values in the order of metric_id."""
    pairs = F.array_sort(F.collect_list(F.struct("metric_id", "z_value")))
    return features.groupBy("entity", "year").agg(F.transform(pairs, lambda p: p["z_value"]).alias("profile"))
