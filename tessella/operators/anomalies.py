"""Spatial outliers, structural breaks, methodology changes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.contracts import ANOMALIES, enforce
from tessella.functions.lineage import checkpoint
from tessella.functions.quantiles import quantiles
from tessella.functions.stats import ratio


def structural_breaks(fact: DataFrame, max_ratio: float = 0.5, min_len: int = 8, drop_zero_shift: bool = False) -> DataFrame:
    """One level shift per (entity, metric) series of at least ``min_len`` values: the split of least two-level squared
    error, with two values or more on both sides, if that error is at most ``max_ratio`` of a straight line's.

    The series are centred first; prefix sums over a window give the error of every split, so no Python is needed.
    """
    key = ["entity", "metric_id"]
    rows = fact.where("value is not null").select(*key, "year", "value")
    stats = rows.groupBy(*key).agg(F.avg("value").alias("m"), F.count("*").alias("n")).where(F.col("n") >= min_len)
    rows = rows.join(stats, key).withColumn("x", F.col("value") - F.col("m"))
    order = Window.partitionBy(*key).orderBy("year")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("s1", F.sum("x").over(upto)).withColumn("s2", F.sum(F.col("x") * F.col("x")).over(upto)).withColumn("next", F.lead("year").over(order))
    i = F.col("i")
    totals = rows.groupBy(*key).agg(F.sum("x").alias("t1"), F.sum(F.col("x") ** 2).alias("t2"), F.sum((i - 1) * F.col("x")).alias("sxy"))
    rows = rows.join(totals, key)
    n, s1, t1 = F.col("n"), F.col("s1"), F.col("t1")
    step = F.col("t2") - ratio(s1 * s1, i) - ratio((t1 - s1) * (t1 - s1), n - i)
    sxy = F.col("sxy") - t1 * (n - 1) / 2
    line = F.col("t2") - t1 * t1 / n - sxy * sxy / ((n * n - 1) * n / 12)
    rows = rows.where((i >= 2) & (i <= n - 2)).withColumn("step", F.round(F.greatest(step, F.lit(0.0)), 8)).withColumn("line", F.greatest(line, F.lit(0.0)))
    rows = rows.withColumn("score", F.abs(ratio(t1 - s1, n - i) - ratio(s1, i)))
    best = rows.groupBy(*key).agg(F.min_by(F.struct("next", "score", "step", "line"), F.struct("step", "i")).alias("b")).select(*key, "b.*")
    share = F.when(F.col("line") <= 1e-12, F.when(F.col("step") < 1e-12, 0.0)).otherwise(ratio(F.col("step"), F.col("line")))
    best = best.where(share <= max_ratio).select(*key, F.col("next").alias("year"), "score")
    return best.where("score > 0") if drop_zero_shift else best


def methodology_candidates(breaks: DataFrame, metrics: DataFrame, entities: int, domains: list[str], shocks: list[int], fraction: float = 0.5) -> DataFrame:
    """(metric_id, year, score): breaks of one year in a large share of the entities, in domains that are revised, and not
    in a year of a known shock."""
    own = metrics.where(F.col("domain").isin(*domains)).select("metric_id")
    rows = breaks.join(own, "metric_id", "left_semi")
    rows = rows.where(~F.col("year").isin(*shocks)) if shocks else rows
    return rows.groupBy("metric_id", "year").agg((F.countDistinct("entity") / F.lit(entities)).alias("score")).where(F.col("score") >= fraction)


FOREST = "g long, t int, feature array<int>, cut array<double>, under array<int>, over array<int>, path array<double>, norm double"


def _path(n: float) -> float:
    """Mean depth at which a random tree isolates one of ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """One tree of random splits, as arrays over its nodes; a leaf has feature -1 and the depth that it stands for."""
    tree: dict[str, list] = {k: [] for k in ("feature", "cut", "under", "over", "path")}
    waiting = [(np.arange(len(x)), 0, -1, "")]
    most = max(1, math.ceil(math.log2(max(2, len(x)))))
    while waiting:
        rows, depth, parent, side = waiting.pop()
        node = len(tree["feature"])
        if side:
            tree[side][parent] = node
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_ = np.flatnonzero(low < high)
        split = depth < most and len(open_) > 0
        f = int(rng.choice(open_)) if split else -1
        cut = float(rng.uniform(low[f], high[f])) if split else 0.0
        below = x[rows, f] < cut if split else None
        if not split or below.all() or not below.any():
            f, split = -1, False
        for k, v in (("feature", f), ("cut", cut), ("under", -1), ("over", -1), ("path", 0.0 if split else depth + _path(len(rows)))):
            tree[k].append(v)
        if split:
            waiting += [(rows[~below], depth + 1, node, "over"), (rows[below], depth + 1, node, "under")]
    return tree


def _forest(profiles: DataFrame, trees: int, sample: int, pool: int, seed: int) -> DataFrame:
    """A row for each group ``g`` and tree. A group's trees draw ``sample`` rows each from its ``pool`` rows of smallest
    hash; the trees are grown in tasks of their own. Tasks hand on no more than their own ``pool`` rows a group."""
    order = Window.partitionBy("g").orderBy(F.xxhash64("entity", "year", F.lit(seed)), "entity", "year")
    drawn = profiles.withColumn("k", F.row_number().over(order)).where(F.col("k") <= pool).select("g", "k", "profile", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t"))

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        x = np.array(own.sort_values("k")["profile"].tolist(), dtype=np.float64)
        rng = np.random.default_rng([seed, int(key[0]) & 0xFFFFFFFF, int(key[1])])
        size = min(sample, len(x))
        tree = _grow(x[rng.choice(len(x), size, replace=False)], rng)
        return pd.DataFrame([{"g": key[0], "t": key[1], **tree, "norm": _path(size) or 1.0}])

    return drawn.groupBy("g", "t").applyInPandas(run, FOREST)


def _raw_scores(profiles: DataFrame, forest: DataFrame, block: int = 8192) -> DataFrame:
    """(entity, year, g, raw): lower is stranger, from -1 to 0. Blocks of a group's profiles meet its trees."""
    sizes = profiles.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = profiles.join(sizes, "g").select("g", F.pmod(F.xxhash64("entity", "year"), F.col("blocks")).cast("int").alias("b"), "entity", "year", "profile")
    dealt = forest.join(sizes, "g").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def run(own: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if own.empty or trees.empty:
            return pd.DataFrame({"entity": [], "year": [], "g": [], "raw": []})
        x, total, at = np.array(own["profile"].tolist(), dtype=np.float64), np.zeros(len(own)), np.arange(len(own))
        for tree in trees.sort_values("t").itertuples():  # sums of the same order, however the trees arrive
            feature, cut, under, over = (np.asarray(v) for v in (tree.feature, tree.cut, tree.under, tree.over))
            node = np.zeros(len(own), dtype=np.int64)
            while (inner := feature[node] >= 0).any():
                f = np.where(inner, feature[node], 0)
                node = np.where(inner, np.where(x[at, f] < cut[node], under[node], over[node]), node)
            total += np.asarray(tree.path)[node]
        return pd.DataFrame({"entity": own["entity"], "year": own["year"], "g": own["g"], "raw": -(2.0 ** (-total / len(trees) / trees["norm"].iloc[0]))})

    return rows.groupBy("g", "b").cogroup(dealt.groupBy("g", "b")).applyInPandas(run, "entity string, year long, g long, raw double")


def _fit(profiles: DataFrame, contamination: float, trees: int, sample: int, pool: int, seed: int) -> DataFrame:
    forest = checkpoint(_forest(profiles, trees, sample, pool, seed))
    offsets = quantiles(_raw_scores(profiles, forest), ["g"], "raw", {"offset": contamination})
    return checkpoint(forest.join(offsets, "g"))


def _decided(profiles: DataFrame, model: DataFrame) -> DataFrame:
    offsets = model.select("g", "offset").distinct()
    found = _raw_scores(profiles, model.drop("offset")).join(offsets, "g")
    return found.select("entity", "year", (F.col("raw") - F.col("offset")).alias("score"), (F.col("raw") < F.col("offset")).alias("is_anomaly"))


def train_anomaly_model(profiles: DataFrame, contamination: float = 0.05, seed: int = 42, trees: int = 100, sample: int = 256, pool: int = 1000) -> DataFrame:
    """A forest over all (entity, year, profile) rows, as a table of its trees with the offset that flags a share of
    ``contamination``. Trees are grown from a bounded sample, the ``pool`` rows of smallest hash; the offset is exact."""
    return _fit(profiles.withColumn("g", F.lit(0).cast("long")), contamination, trees, sample, pool, seed)


def score_anomalies(profiles: DataFrame, model: DataFrame) -> DataFrame:
    """(entity, year, score, is_anomaly): the score less the model's offset; negative is flagged."""
    return _decided(profiles.withColumn("g", F.lit(0).cast("long")), model)


def save_anomaly_model(model: DataFrame, folder: str, scored: DataFrame) -> None:
    """Write a model and its card: the rows of ``scored`` and their flagged share. The card comes last."""
    model.write.mode("overwrite").parquet(f"{folder}/trees")
    scored.agg(F.count("*").alias("n_samples"), F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_share")).write.mode("overwrite").parquet(f"{folder}/card")


def load_anomaly_model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A saved model and its card."""
    return spark.read.parquet(f"{folder}/trees"), spark.read.parquet(f"{folder}/card")


def spatial_outliers(profiles: DataFrame, contamination: float = 0.05, seed: int = 42, least: int = 3, trees: int = 100, sample: int = 256, pool: int = 1000) -> DataFrame:
    """Outliers of each year by a forest of its own; years of fewer than ``least`` rows are skipped."""
    years = profiles.groupBy("year").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("year")
    rows = checkpoint(profiles.join(years, "year").select("entity", "year", "profile", F.col("year").cast("long").alias("g")))
    return _decided(rows, _fit(rows, contamination, trees, sample, pool, seed))


def run_anomalies(outliers: DataFrame, breaks: DataFrame, methodology: DataFrame) -> DataFrame:
    """The three kinds under one schema, by kind, year and score; what a kind has no value for is null."""
    null = F.lit(None)
    a = outliers.where("is_anomaly").select(F.lit("spatial_outlier").alias("kind"), "entity", null.alias("metric_id"), "year", "score")
    b = breaks.select(F.lit("structural_break").alias("kind"), "entity", "metric_id", "year", "score")
    c = methodology.select(F.lit("methodology_change").alias("kind"), null.alias("entity"), "metric_id", "year", "score")
    return enforce(a, ANOMALIES).unionByName(enforce(b, ANOMALIES)).unionByName(enforce(c, ANOMALIES)).orderBy("kind", "year", F.desc("score"), "entity", "metric_id")


def predict_profiles(profiles: DataFrame, length: int, forest: DataFrame | None, clusters: DataFrame | None) -> DataFrame:
    """Type and outlier score of complete profiles; incomplete ones give no row, a missing model a null part."""
    whole = profiles.where((F.size("profile") == length) & F.forall("profile", lambda x: x.isNotNull()))
    out = whole.select("entity", "year")
    out = out.join(score_anomalies(whole, forest), ["entity", "year"], "left") if forest is not None else out.withColumns({"score": F.lit(None).cast("double"), "is_anomaly": F.lit(None).cast("boolean")})
    return out.join(clusters, ["entity", "year"], "left") if clusters is not None else out.withColumn("predicted", F.lit(None).cast("long"))
