"""Stability of ranks, agreement of schemes, dispersion, convergence and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import ranking
from tessella.functions.gram import gram
from tessella.functions.joins import null_safe
from tessella.functions.quantiles import quantiles
from tessella.functions.stats import correlation, ratio


def ranked(dev: DataFrame) -> DataFrame:
    """(entity, year, scheme, total_score, rank) of the rows with a score."""
    rows = dev.where("total_score is not null").select("entity", "year", "scheme", "total_score")
    return ranking.ordinal(rows, "rank", "total_score", "entity", "scheme", "year")


def rank_stability(dev: DataFrame, min_years: int) -> DataFrame:
    """Spread of an entity's rank over the years of a scheme, and its mean change from one available year to the next."""
    step = F.abs(F.col("rank") - F.lag("rank").over(Window.partitionBy("scheme", "entity").orderBy("year")))
    out = ranked(dev).withColumn("step", step).groupBy("entity", "scheme").agg(
        F.count("*").alias("n_years"), F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("std_rank"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), (F.max("rank") - F.min("rank")).alias("rank_range"), F.avg("step").alias("mean_abs_change"),
    )
    return out.where(F.col("n_years") >= min_years)


def rank_robustness(dev: DataFrame) -> DataFrame:
    """Spread of an entity's rank over the schemes of a year."""
    return ranked(dev).groupBy("entity", "year").agg(
        F.count("*").alias("n_schemes"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), (F.max("rank") - F.min("rank")).alias("rank_range"), F.avg("rank").alias("mean_rank"), F.min("total_score").alias("score_min"), F.max("total_score").alias("score_max"),
    )


def scheme_agreement(dev: DataFrame) -> DataFrame:
    """Spearman's correlation of each pair of schemes per year, over at least 3 entities that have both scores."""
    rows = dev.where("total_score is not null").select("entity", "year", "scheme", "total_score")
    a = rows.select("entity", "year", F.col("scheme").alias("scheme_a"), F.col("total_score").alias("x"))
    b = rows.select("entity", "year", F.col("scheme").alias("scheme_b"), F.col("total_score").alias("y"))
    both = a.join(b, ["entity", "year"]).where("scheme_a < scheme_b")
    key = ["year", "scheme_a", "scheme_b"]
    both = ranking.average(ranking.average(both, "rx", "x", "entity", *key), "ry", "y", "entity", *key)
    return both.groupBy(*key).agg(F.round(correlation("rx", "ry"), 4).alias("spearman"), F.count("*").alias("n")).where("n >= 3")


def scheme_sensitivity(agreement: DataFrame) -> DataFrame:
    """Mean and least agreement of each pair of schemes over the years."""
    return agreement.groupBy("scheme_a", "scheme_b").agg(F.avg("spearman").alias("mean_spearman"), F.min("spearman").alias("min_spearman"))


def dispersion(features: DataFrame, metrics: DataFrame, least: int) -> DataFrame:
    """Spread of the harmonised values per (metric, year); relative measures only for positive ratio scales."""
    v = "value_harmonized"
    out = features.groupBy("metric_id", "year").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), (F.max(v) - F.min(v)).alias("range"),
    ).where(F.col("n") >= least).join(metrics.select("metric_id", "value_type"), "metric_id")
    shares = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    out = null_safe(out, quantiles(features, ["metric_id", "year"], v, shares), ["metric_id", "year"]).withColumn("iqr", F.col("p75") - F.col("p25"))
    scale = F.col("value_type").isin("absolute", "per_capita", "share")
    out = out.withColumn("cv", F.when(scale & (F.col("mean") > 0), ratio(F.col("std"), F.col("mean")))).withColumn("p90_p10", F.when(scale & (F.col("p10") > 0), ratio(F.col("p90"), F.col("p10"))))
    return out.select("metric_id", "year", "n", "mean", "median", "std", "p10", "p90", "iqr", "range", "cv", "p90_p10")


def index_dispersion(dev: DataFrame, least: int = 5) -> DataFrame:
    """Spread of the index per (year, scheme), with population deviation and Gini coefficient."""
    key, s = ["year", "scheme"], "total_score"
    rows = ranking.ordinal(dev.where("total_score is not null").select(*key, "entity", s), "i", s, "entity", *key, descending=False)
    out = rows.groupBy(*key).agg(F.count("*").alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.sum(s).alias("_sum"), F.sum(F.col("i") * F.col(s)).alias("_isum"))
    out = null_safe(out.where(F.col("n") >= least), quantiles(rows, key, s, {"p10": 0.1, "p90": 0.9}), key)
    gini = F.when(F.col("_sum") > 0, ratio(2 * F.col("_isum") - (F.col("n") + 1) * F.col("_sum"), F.col("n") * F.col("_sum")))
    return out.withColumn("cv", F.when(F.col("mean") > 0, ratio(F.col("std"), F.col("mean")))).withColumn("p90_p10", F.when(F.col("p10") > 0, ratio(F.col("p90"), F.col("p10")))).withColumn("gini", gini).drop("_sum", "_isum")


def beta_convergence(dev: DataFrame, least: int = 5) -> DataFrame:
    """Per scheme, the growth from the first to the last year regressed on the first year's level."""
    span = dev.groupBy("scheme").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year")).where("first_year < last_year")
    rows = dev.join(span, "scheme").where(F.col("year").isin(F.col("first_year"), F.col("last_year")))
    pick = lambda y, n: F.max(F.when(F.col("year") == F.col(y), F.col("total_score"))).alias(n)
    pairs = rows.groupBy("scheme", "entity", "first_year", "last_year").agg(pick("first_year", "x"), pick("last_year", "y1")).where("x is not null and y1 is not null").withColumn("y", F.col("y1") - F.col("x"))
    out = pairs.groupBy("scheme", "first_year", "last_year").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("intercept"), correlation("x", "y").alias("r")).where(F.col("n") >= least)
    return out.withColumn("r2", F.col("r") * F.col("r"))


def metric_correlations(features: DataFrame, method: str, least: int) -> DataFrame:
    """(year, metric_a < metric_b, r, n): pairwise correlations over the entities that have every metric of the year.

    Values, or their average ranks, are centred and scaled to length one by metric, so that correlations are the Gram
    matrix of the entities' vectors; a metric without spread has none.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown method: {method}")
    rows = features.where("value_harmonized is not null").select("entity", "year", "metric_id", F.col("value_harmonized").alias("v"))
    full = rows.groupBy("year").agg(F.countDistinct("metric_id").alias("m")).where("m >= 2")
    whole = rows.groupBy("year", "entity").agg(F.count("*").alias("k")).join(full, "year").where("k = m").select("year", "entity")
    rows = rows.join(whole, ["year", "entity"], "left_semi")
    if method == "spearman":
        rows = ranking.average(rows, "rank", "v", "entity", "year", "metric_id").select("entity", "year", "metric_id", F.col("rank").alias("v"))
    stats = rows.groupBy("year", "metric_id").agg(F.count("*").alias("n"), F.avg("v").alias("m"), (F.stddev_pop("v") * F.sqrt(F.count("*"))).alias("size"), (F.max("v") == F.min("v")).alias("flat"))
    rows = rows.join(stats, ["year", "metric_id"]).where((F.col("n") >= least) & ~F.col("flat"))
    # a year's vectors hold the same metrics, so a place in them is that of the metric in the year's sorted list
    vectors = rows.groupBy("year", "entity").agg(F.array_sort(F.collect_list(F.struct("metric_id", ((F.col("v") - F.col("m")) / F.col("size")).alias("z")))).alias("s"))
    names = stats.where((F.col("n") >= least) & ~F.col("flat")).groupBy("year").agg(F.sort_array(F.collect_list("metric_id")).alias("ids"), F.first("n").alias("n"))
    found = gram(vectors.select(F.col("year").alias("key"), F.transform("s", lambda x: x["z"]).alias("x"))).withColumnRenamed("key", "year").join(names, "year")
    return found.select("year", F.col("ids")[F.col("i").cast("int")].alias("metric_a"), F.col("ids")[F.col("j").cast("int")].alias("metric_b"), F.col("g").alias("r"), "n")


def top_correlations(corr: DataFrame, metrics: DataFrame, year: int | None = None, metric: int | None = None, limit: int = 10) -> DataFrame:
    """The strongest pairs of a year (the last by default), of one metric if given, with names."""
    rows = corr.where(F.col("year") == year) if year else corr.join(F.broadcast(corr.agg(F.max("year").alias("year"))), "year", "left_semi")
    rows = rows.where((F.col("metric_a") == metric) | (F.col("metric_b") == metric)) if metric else rows
    for k in ("a", "b"):
        rows = rows.join(metrics.select(F.col("metric_id").alias(f"metric_{k}"), F.col("metric_name").alias(f"name_{k}")), f"metric_{k}", "left")
    return rows.orderBy(F.round(F.abs("r"), 8).desc(), "metric_a", "metric_b").limit(limit)
