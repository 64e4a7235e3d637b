"""Data quality and the metric catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.stats import ratio


def data_quality(features: DataFrame, fact: DataFrame) -> DataFrame:
    """Per (metric, year): grid cells, cells with a raw value, imputed cells, and both shares."""
    raw = fact.where("value is not null").select("entity", "metric_id", "year").distinct().withColumn("raw", F.lit(True))
    rows = features.join(raw, ["entity", "metric_id", "year"], "left").groupBy("metric_id", "year")
    out = rows.agg(F.count("*").alias("cells"), F.count_if("raw").alias("raw_cells"), F.count_if("is_imputed").alias("imputed_cells"))
    return out.withColumn("raw_share", ratio(F.col("raw_cells"), F.col("cells"))).withColumn("imputed_share", ratio(F.col("imputed_cells"), F.col("cells")))


def data_quality_rollup(quality: DataFrame, metrics: DataFrame) -> DataFrame:
    """The shares by year, by domain and by metric, in one pass over grouping sets; sums are divided, not shares averaged."""
    rows = quality.join(metrics.select("metric_id", "domain"), "metric_id")
    sets = rows.groupingSets([["year"], ["domain"], ["metric_id"]], "year", "domain", "metric_id")
    out = sets.agg(F.sum("cells").alias("cells"), F.sum("raw_cells").alias("raw_cells"), F.sum("imputed_cells").alias("imputed_cells"))
    return out.withColumn("raw_share", ratio(F.col("raw_cells"), F.col("cells"))).withColumn("imputed_share", ratio(F.col("imputed_cells"), F.col("cells")))


def metric_catalog(metrics: DataFrame, fact: DataFrame, least: float, excluded: str = "other") -> DataFrame:
    """Each metric's span of non-null facts and its tier: core, extended (enough coverage, not ``excluded``) or sparse."""
    seen = fact.where("value is not null").groupBy("metric_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("year").alias("n_years"), F.countDistinct("entity").alias("n_entities"))
    tier = F.when(F.col("is_core"), "core").when((F.col("coverage") >= least) & (F.col("domain") != excluded), "extended").otherwise("sparse")
    return metrics.join(seen, "metric_id", "left").na.fill(0, ["n_years", "n_entities"]).select("metric_id", "metric_name", "domain", "is_core", "coverage", tier.alias("tier"), "first_year", "last_year", "n_years", "n_entities")


def core_counts(metrics: DataFrame, by: str) -> DataFrame:
    """(``by``, n): core metrics by domain or value type, most first."""
    return metrics.where("is_core").groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def clustering_summary(clusters: DataFrame, silhouette: DataFrame, stability: DataFrame) -> DataFrame:
    """One row: number of clusters, years, and the means over years of silhouette and of the share of labels that stay."""
    seen = clusters.agg(F.countDistinct("cluster_id").alias("k"), F.countDistinct("year").alias("years"))
    return seen.crossJoin(silhouette.agg(F.avg("silhouette").alias("silhouette"))).crossJoin(stability.agg(F.avg("stability").alias("stability")))


def data_profile(regions: DataFrame, fact: DataFrame, metrics: DataFrame, features: DataFrame, dev: DataFrame) -> DataFrame:
    """One row of counts over all tables, with the funnel of metrics by coverage."""
    funnel = [F.count_if(F.col("coverage") >= c).alias(f"coverage_{int(100 * c)}") for c in (0.95, 0.9, 0.8, 0.5)]
    parts = (
        regions.agg(F.count("*").alias("regions"), F.count_if("included").alias("included"), F.countDistinct("district").alias("districts")),
        fact.agg(F.count("*").alias("facts"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("source").alias("sources")),
        metrics.agg(F.count_if("is_core").alias("core_metrics"), F.countDistinct("value_type").alias("value_types"), *funnel),
        features.agg(F.avg(F.col("is_imputed").cast("double")).alias("imputed_share")),
        dev.agg(F.count("*").alias("index_rows")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out
