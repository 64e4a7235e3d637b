"""Composite index, rankings, what-if scenarios and decomposition."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import ranking
from tessella.functions.stats import ratio, scaled


def domain_scores(features: DataFrame, metrics: DataFrame, domains: list[str]) -> DataFrame:
    """(entity, year, one column per domain): mean z, with the sign of the metric's direction; a null one counts as down."""
    sign = F.when(F.coalesce("higher_is_better", F.lit(False)), 1).otherwise(-1)
    rows = features.join(metrics.select("metric_id", "domain", "higher_is_better"), "metric_id").withColumn("signed", F.col("z_value") * sign)
    return rows.groupBy("entity", "year").pivot("domain", domains).agg(F.avg("signed")).select("entity", "year", *domains)


def scheme_weights(wide: DataFrame, domains: list[str], scheme: str, expert: dict[str, float] | None = None) -> dict[str, float]:
    """Weights of the domains: equal, expert (renormalised), or pca, the first component of their covariance.

    The covariances come from one aggregate of d x d numbers. A sum of zero or less falls back to equal weights.
    """
    equal = dict.fromkeys(domains, 1 / len(domains))
    if scheme == "equal":
        return equal
    if scheme == "expert":
        own = {d: float((expert or {}).get(d, 0.0)) for d in domains}
    elif scheme == "pca":
        row = wide.na.drop(subset=domains).agg(*[F.covar_samp(a, b).alias(f"{i}_{j}") for i, a in enumerate(domains) for j, b in enumerate(domains)]).first()
        cov = np.array([[row[f"{i}_{j}"] or 0.0 for j in range(len(domains))] for i in range(len(domains))])
        first = np.linalg.eigh(cov)[1][:, -1]
        own = dict(zip(domains, (first if first.sum() >= 0 else -first).tolist(), strict=True))
    else:
        raise ValueError(f"unknown scheme: {scheme}")
    total = sum(own.values())
    return {d: w / total for d, w in own.items()} if total > 1e-12 else equal


def weighted(domains: list[str], weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(d) * F.lit(float(weights[d])) for d in domains])


def to_100(df: DataFrame, column: str, *group: str) -> DataFrame:
    """``column`` scaled to 0..100 over each group (the whole table without one), by an aggregate and a join."""
    low, high = F.min(column).alias("_low"), F.max(column).alias("_high")
    joined = df.join(df.groupBy(*group).agg(low, high), list(group)) if group else df.crossJoin(F.broadcast(df.agg(low, high)))
    return joined.withColumn(column, scaled(F.col(column), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def dev_index(wide: DataFrame, domains: list[str], schemes: dict[str, dict[str, float]]) -> DataFrame:
    """(entity, year, scheme, total_score, domains): the weighted sum of each scheme, scaled over its whole window."""
    each = [F.struct(F.lit(s).alias("scheme"), weighted(domains, w).alias("total_score")) for s, w in schemes.items()]
    rows = wide.withColumn("s", F.explode(F.array(*each))).select("entity", "year", "s.scheme", "s.total_score", *domains)
    return to_100(rows, "total_score", "scheme").select("entity", "year", "scheme", "total_score", *domains)


def index_ranking(dev: DataFrame, year: int, scheme: str) -> DataFrame:
    """The entities of a year and scheme by score."""
    rows = dev.where((F.col("year") == year) & (F.col("scheme") == scheme))
    return ranking.ordinal(rows, "position", "total_score", "entity", "year", "scheme")


def custom_index(dev: DataFrame, year: int, weights: dict[str, float], base: str = "equal") -> DataFrame:
    """An index of own weights: negative ones are 0, all zero means equal; scaled in the year, at two decimals, with its
    rank, the rank of the base scheme, and how many places it gains."""
    own = {d: max(0.0, w) for d, w in weights.items()}
    total = sum(own.values())
    own = {d: w / total if total else 1 / len(own) for d, w in own.items()}
    rows = dev.where((F.col("year") == year) & (F.col("scheme") == base)).na.fill(0.0, list(own))
    rows = to_100(rows.withColumn("custom_score", weighted(list(own), own)), "custom_score").withColumn("custom_score", F.round("custom_score", 2))
    rows = ranking.ordinal(ranking.ordinal(rows, "rank", "custom_score", "entity", "year"), "base_rank", "total_score", "entity", "year")
    return rows.select("entity", "custom_score", "rank", "base_rank", (F.col("base_rank") - F.col("rank")).alias("delta"))


def custom_movers(ranked: DataFrame) -> DataFrame:
    """One row: who gains and who loses most places; ties by entity."""
    up, down = F.struct(-F.col("delta"), F.col("entity")), F.struct("delta", "entity")
    return ranked.agg(F.min_by("entity", up).alias("riser"), F.max("delta").alias("gain"), F.min_by("entity", down).alias("faller"), F.min("delta").alias("loss"))


def _ranks_if(rows: DataFrame, target: DataFrame) -> DataFrame:
    """For each row of ``target`` (key, entity, score): 1 + the others above it, or equal with a smaller entity."""
    other = rows.select(F.col("entity").alias("o"), F.col("score").alias("os"))
    above = (F.col("o") != F.col("entity")) & ((F.col("os") > F.col("new")) | ((F.col("os") == F.col("new")) & (F.col("o") < F.col("entity"))))
    return target.join(other, above, "left").groupBy("key").agg((F.count("o") + 1).alias("rank"))


def _year(dev: DataFrame, year: int, domains: list[str]) -> DataFrame:
    rows = dev.where((F.col("year") == year) & (F.col("scheme") == "equal")).na.fill(0.0, domains)
    return rows.select("entity", *domains, (reduce(lambda a, b: a + b, [F.col(d) for d in domains]) / len(domains)).alias("score"))


def scenario(dev: DataFrame, year: int, entity: str, percentiles: dict[str, float], domains: list[str]) -> DataFrame:
    """One row: an entity's rank by the mean of the domains, and if some stood at given percentiles of the year.

    Percentiles are held to 0..100 and interpolated; an unknown entity gives no row. The one target is broadcast.
    """
    rows = _year(dev, year, domains)
    at = rows.agg(*[F.percentile(d, F.lit(min(100.0, max(0.0, p)) / 100)).alias(f"p_{d}") for d, p in percentiles.items()])
    own = rows.where(F.col("entity") == entity).crossJoin(F.broadcast(at))
    new = reduce(lambda a, b: a + b, [F.col(f"p_{d}") if d in percentiles else F.col(d) for d in domains]) / len(domains)
    own = own.select("entity", F.col("score"), new.alias("raised")).select("entity", F.explode(F.create_map(F.lit("baseline"), "score", F.lit("scenario"), "raised")).alias("key", "new"))
    ranks = _ranks_if(rows, F.broadcast(own)).groupBy().pivot("key", ["baseline", "scenario"]).agg(F.first("rank"))
    return ranks.where("baseline is not null").select(F.lit(entity).alias("entity"), "baseline", "scenario", (F.col("baseline") - F.col("scenario")).alias("delta"))


def domain_percentiles(dev: DataFrame, year: int, domains: list[str]) -> DataFrame:
    """(entity, domain, percentile): the share of the year's values up to the own one, in percent at one decimal."""
    rows = _year(dev, year, domains).unpivot("entity", domains, "domain", "value")
    return ranking.share_up_to(rows, "share", "value", "entity", "domain").select("entity", "domain", F.round(100 * F.col("share"), 1).alias("percentile"))


def scenario_sensitivity(dev: DataFrame, year: int, entity: str, domains: list[str]) -> DataFrame:
    """(domain, gain): places that an entity gains if a domain rises to the year's maximum."""
    rows = _year(dev, year, domains)
    top = rows.agg(*[F.max(d).alias(f"top_{d}") for d in domains])
    own = rows.where(F.col("entity") == entity).crossJoin(F.broadcast(top))
    each = [F.struct(F.lit(d).alias("key"), (F.col("score") + (F.col(f"top_{d}") - F.col(d)) / len(domains)).alias("new")) for d in domains]
    own = own.select("entity", F.explode(F.array(*each, F.struct(F.lit("").alias("key"), F.col("score").alias("new")))).alias("s")).select("entity", "s.key", "s.new")
    ranks = _ranks_if(rows, F.broadcast(own))
    now = ranks.where("key = ''").select(F.col("rank").alias("now"))
    return ranks.where("key <> ''").crossJoin(F.broadcast(now)).select(F.col("key").alias("domain"), (F.col("now") - F.col("rank")).alias("gain"))


def decompose_index(dev: DataFrame, domains: list[str], schemes: dict[str, dict[str, float]]) -> DataFrame:
    """(entity, year, scheme, domain, contribution, delta_total): the parts of a year's change, which sum to it."""
    before = Window.partitionBy("entity", "scheme").orderBy("year")
    rows = dev
    for c in ("year", "total_score", *domains):
        rows = rows.withColumn(f"_{c}", F.lag(c).over(before))
    rows = rows.where((F.col("year") - F.col("_year") == 1) & F.col("total_score").isNotNull() & F.col("_total_score").isNotNull())
    weight = lambda d: reduce(lambda a, s: a.when(F.col("scheme") == s, schemes[s][d]), schemes, F.when(F.lit(False), 0.0))
    parts = {d: weight(d) * (F.col(d) - F.col(f"_{d}")) for d in domains}
    rows = rows.withColumn("den", reduce(lambda a, b: a + b, parts.values())).withColumn("delta_total", F.col("total_score") - F.col("_total_score"))
    each = [F.struct(F.lit(d).alias("domain"), F.when(F.abs("den") < 1e-9, 0.0).otherwise(ratio(F.col("delta_total") * p, F.col("den"))).alias("contribution")) for d, p in parts.items()]
    return rows.withColumn("x", F.explode(F.array(*each))).select("entity", "year", "scheme", "x.domain", "x.contribution", "delta_total")


def region_dashboard(dev: DataFrame, domains: list[str], year: int, scheme: str) -> DataFrame:
    """Per entity and domain: score, last year's, change; and the total's rank, number of entities and change."""
    rows = ranking.placed(dev.where((F.col("scheme") == scheme) & F.col("year").isin(year, year - 1)), "total_score", "entity", "year", "scheme", descending=True)
    rows = rows.withColumn("rank", F.col("_place")).withColumn("of", F.col("_of"))
    now, old = rows.where(F.col("year") == year), rows.where(F.col("year") == year - 1)
    old = old.select("entity", F.col("total_score").alias("old_total"), *[F.col(d).alias(f"old_{d}") for d in domains])
    each = [F.struct(F.lit(d).alias("domain"), F.col(d).alias("score"), F.col(f"old_{d}").alias("previous")) for d in domains]
    both = now.join(old, "entity", "left").withColumn("x", F.explode(F.array(*each)))
    return both.select("entity", "x.domain", "x.score", "x.previous", (F.col("x.score") - F.col("x.previous")).alias("delta"), "rank", "of", (F.col("total_score") - F.col("old_total")).alias("total_delta"))


def dashboard_types(clusters: DataFrame, attribution: DataFrame, year: int, top: int = 8) -> DataFrame:
    """(entity, cluster_id, place, metric_id, value): an entity's cluster in a year and the metrics that speak most for or
    against it. An entity without attribution has one row, with nulls."""
    size = -F.round(F.abs("value"), 8)
    best = attribution.where(F.col("year") == year).groupBy("entity").agg(F.slice(F.sort_array(F.collect_list(F.struct(size.alias("s"), "metric_id", "value"))), 1, top).alias("best"))
    rows = clusters.where(F.col("year") == year).select("entity", "cluster_id").join(best, "entity", "left")
    rows = rows.select("entity", "cluster_id", F.posexplode_outer("best").alias("place", "x"))
    return rows.select("entity", "cluster_id", (F.col("place") + 1).alias("place"), "x.metric_id", "x.value")
