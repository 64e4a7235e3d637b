"""Yearly clusters with stable labels, their profiles, transitions, twins and classifiers."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import ranking
from tessella.functions.joins import with_small
from tessella.functions.lineage import Tables, checkpoint, shuffles_freed
from tessella.functions.stats import ratio
from tessella.operators.features import profile_vector
from tessella.sources.versions import get_text, names, put_text


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]


def _sums(rows: DataFrame, centres: dict[tuple[int, int, int], np.ndarray]) -> DataFrame:
    """(year, k, start, c, dim, value): sums over each centre's nearest profiles, then their number and total distance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for year, own in batch.groupby("year"):
                x = np.array(own["profile"].tolist(), dtype=np.float64)
                for key in (c for c in centres if c[0] == year):
                    far = _far(x, centres[key])
                    near = far.argmin(axis=1)
                    member = np.zeros(far.shape)
                    member[np.arange(len(x)), near] = 1
                    part = np.column_stack([member.T @ x, member.sum(axis=0), member.T @ np.maximum(far.min(axis=1), 0)])
                    sums[key] = sums[key] + part if key in sums else part
        for (year, k, start), s in sums.items():
            c, dim = np.indices(s.shape)
            yield pd.DataFrame({"year": year, "k": k, "start": start, "c": c.ravel(), "dim": dim.ravel(), "value": s.ravel()})

    parts = rows.select("year", "profile").mapInPandas(run, "year long, k int, start int, c int, dim int, value double")
    return parts.groupBy("year", "k", "start", "c", "dim").agg(F.sum("value").alias("value"))


def _best_centres(rows: DataFrame, ks: list[int], seed: int, starts: int, rounds: int = 30) -> dict[tuple[int, int], np.ndarray]:
    """The cheapest centres of each (year, k) among ``starts`` draws of distinct profiles, in order of their coordinates.

    All years, numbers of clusters and starts move in the same pass over the profiles; only their centres and sums, of
    a size fixed by the parameters, reach the driver.
    """
    drawn = rows.select("year", "profile").distinct().withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    order = Window.partitionBy("year", "start").orderBy(F.xxhash64("profile", "start", F.lit(seed)), "profile")
    drawn = drawn.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(ks)).orderBy("year", "start", "r").collect()
    firsts: dict[tuple[int, int], list] = {}
    for r in drawn:
        firsts.setdefault((r.year, r.start), []).append(r.profile)
    centres = {(y, k, s): np.array(p[:k], dtype=np.float64) for (y, s), p in firsts.items() for k in ks}
    moving, cost = dict(centres), {}
    for _ in range(rounds):
        if not moving:
            break
        for (y, k, s), own in _sums(rows, moving).toPandas().groupby(["year", "k", "start"]):
            old = moving[y, k, s]
            sums = np.zeros((len(old), old.shape[1] + 2))
            sums[own["c"], own["dim"]] = own["value"]
            size, cost[y, k, s] = sums[:, -2:-1], float(sums[:, -1].sum())
            new = np.where(size > 0, sums[:, :-2] / np.maximum(size, 1), old)
            centres[y, k, s] = new
            if np.abs(new - old).max() < 1e-9:
                del moving[y, k, s]
            else:
                moving[y, k, s] = new
    best: dict[tuple[int, int], tuple] = {}
    for (y, k, s), c in cost.items():
        best[y, k] = min(best.get((y, k), (np.inf, 0)), (round(c, 9), s))
    return {(y, k): np.array(sorted(centres[y, k, s].tolist())) for (y, k), (_, s) in best.items()}


def _nearest(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """(entity, year, cluster_id): the nearest of the year's centres, the first on a tie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for year, own in batch.groupby("year"):
                near = _far(np.array(own["profile"].tolist(), dtype=np.float64), centres[year]).argmin(axis=1)
                yield pd.DataFrame({"entity": own["entity"], "year": year, "cluster_id": near})

    return rows.select("entity", "year", "profile").mapInPandas(run, "entity string, year long, cluster_id long")


def cluster_by_period(features: DataFrame, k: int, seed: int = 42, starts: int = 10) -> DataFrame:
    """(entity, year, cluster_id): k-means on each year's profiles, the cheapest of some starts; ids by centroid order.

    A year with fewer than ``k`` distinct profiles has as many clusters as those.
    """
    rows = checkpoint(profile_vector(features))
    return _nearest(rows, {y: c for (y, _), c in _best_centres(rows, [k], seed, starts).items()})


def distance_sums(profiles: DataFrame, block: int = 1024) -> DataFrame:
    """(entity, year, cluster_id, c, far): the sum of Euclidean distances of each profile (entity, year, cluster_id,
    profile) to the members of each cluster of its year. Entities meet as matrices, block by block of a year."""
    sizes = profiles.groupBy("year").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = profiles.join(sizes, "year").withColumn("own", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = dealt.select("year", F.col("own").alias("i"), F.col("other").alias("j"), "entity", "cluster_id", "profile").groupBy("year", "i", "j")
    fresh = [F.col(c).alias(c) for c in ("year", "entity", "cluster_id", "profile")]  # the sides of a cogroup may share no attribute
    right = dealt.select(F.col("other").alias("i"), F.col("own").alias("j"), *fresh).groupBy("year", "i", "j")

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"entity": [], "year": [], "cluster_id": [], "c": [], "far": []})
        x, y = (np.array(s["profile"].tolist(), dtype=np.float64) for s in (a, b))
        middle = y.mean(axis=0)  # distances from products lose fewer digits near the middle
        far = np.sqrt(np.maximum(_far(x - middle, y - middle), 0))
        far[a["entity"].to_numpy()[:, None] == b["entity"].to_numpy()[None, :]] = 0
        labels, at = np.unique(b["cluster_id"].to_numpy(), return_inverse=True)
        sums = far @ np.eye(len(labels))[at]
        row, col = (v.ravel() for v in np.indices(sums.shape))
        return pd.DataFrame({"entity": a["entity"].to_numpy()[row], "year": key[0], "cluster_id": a["cluster_id"].to_numpy()[row], "c": labels[col], "far": sums.ravel()})

    found = left.cogroup(right).applyInPandas(run, "entity string, year long, cluster_id long, c long, far double")
    return found.groupBy("entity", "year", "cluster_id", "c").agg(F.sum("far").alias("far"))


def euclidean_silhouette(features: DataFrame, clusters: DataFrame, block: int = 1024) -> DataFrame:
    """(year, silhouette): the mean over a year's entities of (b - a) / max(a, b), a the mean distance to the others of
    the own cluster and b the least mean distance to another one; 0 in a cluster of one, null without two clusters."""
    sums = distance_sums(profile_vector(features).join(clusters, ["entity", "year"]), block)
    sizes = clusters.groupBy("year", F.col("cluster_id").alias("c")).agg(F.count("*").alias("n"))
    own = F.col("c") == F.col("cluster_id")
    each = sums.join(sizes, ["year", "c"]).groupBy("year", "entity").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("far") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("far") / F.col("n"))).alias("b"))
    s = F.when(F.col("b").isNull(), None).when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(ratio(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return each.groupBy("year").agg(F.avg(s).alias("silhouette"))


def cluster_quality(features: DataFrame, clusters: DataFrame, squared: bool = True) -> DataFrame:
    """Per year: silhouette, Davies-Bouldin and Calinski-Harabasz of given labels; null with under two clusters.

    With ``squared`` the silhouette is that of squared distances, in closed form from each cluster's sums, so no pair is
    formed; else that of distances, by ``distance_sums``.
    """
    rows = features.join(clusters, ["entity", "year"]).select("entity", "year", "metric_id", F.col("z_value").alias("z"), "cluster_id")
    size = clusters.groupBy("year", F.col("cluster_id").alias("c")).agg(F.count("*").alias("n"))
    centre = rows.groupBy("year", F.col("cluster_id").alias("c"), "metric_id").agg(F.avg("z").alias("m"), F.avg(F.col("z") * F.col("z")).alias("m2"))
    # mean squared distance of a point to a cluster's members: sum of z^2 - 2 z m + m2
    far = rows.join(centre, ["year", "metric_id"]).groupBy("year", "entity", "cluster_id", "c").agg(F.sum(F.col("z") ** 2 - 2 * F.col("z") * F.col("m") + F.col("m2")).alias("mean_sq"), F.sum((F.col("z") - F.col("m")) ** 2).alias("sq")).join(size, ["year", "c"])
    own = F.col("c") == F.col("cluster_id")
    each = far.groupBy("year", "entity", "cluster_id").agg(F.max(F.when(own, F.when(F.col("n") > 1, F.col("mean_sq") * F.col("n") / (F.col("n") - 1)))).alias("a"), F.min(F.when(~own, F.col("mean_sq"))).alias("b"), F.max(F.when(own, F.col("sq"))).alias("own_sq"))
    s = F.when(F.col("b").isNull(), None).when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(ratio(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    sil = each.groupBy("year").agg(F.avg(s).alias("silhouette"), F.sum("own_sq").alias("within"), F.count("*").alias("n"), F.countDistinct("cluster_id").alias("k"))
    grand = rows.groupBy("year", "metric_id").agg((F.sum(F.col("z") ** 2) - F.sum("z") ** 2 / F.count("*")).alias("t")).groupBy("year").agg(F.sum("t").alias("total"))
    spread = each.groupBy("year", F.col("cluster_id").alias("c")).agg(F.avg(F.sqrt("own_sq")).alias("s"))
    a, b = (centre.select("year", "metric_id", F.col("c").alias(x), F.col("m").alias(f"m{x}")) for x in ("i", "j"))
    apart = a.join(b, ["year", "metric_id"]).where("i <> j").groupBy("year", "i", "j").agg(F.sqrt(F.sum((F.col("mi") - F.col("mj")) ** 2)).alias("dist"))
    apart = apart.join(spread.select("year", F.col("c").alias("i"), F.col("s").alias("si")), ["year", "i"]).join(spread.select("year", F.col("c").alias("j"), F.col("s").alias("sj")), ["year", "j"])
    db = apart.groupBy("year", "i").agg(F.max(ratio(F.col("si") + F.col("sj"), F.col("dist"))).alias("worst")).groupBy("year").agg(F.avg("worst").alias("davies_bouldin"))
    ch = F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), ratio((F.col("total") - F.col("within")) * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1)))
    if not squared:
        sil = sil.drop("silhouette").join(euclidean_silhouette(features, clusters), "year")
    return sil.join(grand, "year").join(db, "year", "left").select("year", F.when(F.col("k") > 1, F.col("silhouette")).alias("silhouette"), "davies_bouldin", ch.alias("calinski_harabasz"))


def choose_k(features: DataFrame, k_range: range, seed: int = 42, starts: int = 10, squared: bool = False) -> DataFrame:
    """(k, mean_silhouette) best first; the smaller k on a tie. Numbers from the smallest year's entities on are left out.

    The silhouette is that of distances, exact and quadratic in a year's entities, or with ``squared`` that of squares.
    """
    rows = checkpoint(profile_vector(features))
    least = rows.groupBy("year").count().agg(F.min("count")).first()[0] or 0
    ks = [k for k in k_range if k < least]
    if not ks:
        raise ValueError("every k of the range needs more entities than the smallest year has")
    found = _best_centres(rows, ks, seed, starts)
    out = [
        cluster_quality(features, _nearest(rows, {y: c for (y, own), c in found.items() if own == k}), squared).agg(F.avg("silhouette").alias("mean_silhouette")).withColumn("k", F.lit(k).cast("long"))
        for k in ks
    ]
    return reduce(DataFrame.unionByName, out).select("k", "mean_silhouette").orderBy(F.round("mean_silhouette", 9).desc_nulls_last(), "k")


def best_assignment(overlap: np.ndarray) -> list[int]:
    """For each current label (column) the previous one (row), each at most once, so that the overlap is largest; the
    first in order on a tie. Of more labels than before, some get numbers past the last row.

    Shortest augmenting paths over row and column prices, k^3 steps. An overlap counts more than all that order can add.
    """
    k = max(overlap.shape)
    square = np.zeros((k, k), dtype=np.int64)
    square[: overlap.shape[0], : overlap.shape[1]] = overlap
    price = [[-int(square[p, c]) * k**k + p * k ** (k - 1 - c) for p in range(k)] for c in range(k)]
    of_col, of_row, taken = [0] * k, [0] * k, [-1] * k  # taken: the column that has a row
    for start in range(k):
        near, back, seen, c, end = [None] * k, [-1] * k, [False] * k, start, -1
        while end < 0:
            best = None
            for p in range(k):
                if seen[p]:
                    continue
                far = price[c][p] - of_col[c] - of_row[p]
                if near[p] is None or far < near[p]:
                    near[p], back[p] = far, c
                if best is None or near[p] < near[best]:
                    best = p
            step = near[best]
            of_col[start] += step
            for p in range(k):
                if seen[p]:
                    of_row[p] -= step
                    of_col[taken[p]] += step
                elif near[p] is not None:
                    near[p] -= step
            seen[best] = True
            if taken[best] < 0:
                end = best
            else:
                c = taken[best]
        while end >= 0:
            c = back[end]
            before = next((p for p in range(k) if taken[p] == c), -1)
            taken[end] = c
            end = -1 if c == start else before
    rows = [0] * k
    for p, c in enumerate(taken):
        rows[c] = p
    return rows[: overlap.shape[1]]


def align_labels(clusters: DataFrame, k: int) -> DataFrame:
    """Labels renamed year by year to overlap most with the year before; only k x k counts a year reach the driver.

    Years may use fewer than ``k`` labels; a label outside 0 to k - 1 is an error.
    """
    wrong = clusters.where(~F.col("cluster_id").between(0, k - 1)).select("cluster_id").first()
    if wrong:
        raise ValueError(f"label {wrong[0]} is not one of {k}")
    pairs = clusters.select("entity", "year", "cluster_id", F.lag("cluster_id").over(Window.partitionBy("entity").orderBy("year")).alias("p"), F.lag("year").over(Window.partitionBy("entity").orderBy("year")).alias("py"))
    counts: dict[int, np.ndarray] = {}
    for r in pairs.where("py = year - 1").groupBy("year", "p", "cluster_id").count().collect():
        counts.setdefault(r["year"], np.zeros((k, k)))[r["p"], r["cluster_id"]] = r["count"]
    names, last = [], list(range(k))
    for (year,) in sorted(clusters.select("year").distinct().collect()):
        if year in counts:
            moved = np.zeros((k, k))
            for old, new in enumerate(last):
                moved[new] = counts[year][old]
            last = best_assignment(moved)
        else:
            last = list(range(k))
        names += [(year, c, last[c]) for c in range(k)]
    table = clusters.sparkSession.createDataFrame(names, "year long, cluster_id long, label long")
    return clusters.join(F.broadcast(table), ["year", "cluster_id"]).select("entity", "year", F.col("label").alias("cluster_id"))


def label_stability(clusters: DataFrame) -> DataFrame:
    """The share of entities with last year's label; null in the first year."""
    old = clusters.select("entity", (F.col("year") + 1).alias("year"), F.col("cluster_id").alias("old"))
    return clusters.join(old, ["entity", "year"], "left").groupBy("year").agg(F.avg((F.col("cluster_id") == F.col("old")).cast("double")).alias("stability"))


def centroid_distances(features: DataFrame, clusters: DataFrame) -> DataFrame:
    """Euclidean distance of each entity to the mean of its cluster in the year."""
    rows = features.join(clusters, ["entity", "year"])
    means = rows.groupBy("year", "cluster_id", "metric_id").agg(F.avg("z_value").alias("mean_z"))
    return rows.join(means, ["year", "cluster_id", "metric_id"]).groupBy("entity", "year", "cluster_id").agg(F.sqrt(F.sum((F.col("z_value") - F.col("mean_z")) ** 2)).alias("distance"))


def cluster_profile(features: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean z by (year, cluster, metric)."""
    return features.join(clusters, ["entity", "year"]).groupBy("year", "cluster_id", "metric_id").agg(F.avg("z_value").alias("mean_z"))


def cluster_labels(profile: DataFrame, metrics: DataFrame, top: int = 2) -> DataFrame:
    """(year, cluster_id, label): the names of the metrics that stand out most, with arrows."""
    rows = profile.withColumn("size", F.round(F.abs("mean_z"), 8)).withColumn("k", F.row_number().over(Window.partitionBy("year", "cluster_id").orderBy(F.col("size").desc(), "metric_id"))).where(F.col("k") <= top)
    text = F.concat(F.when(F.col("mean_z") >= 0, "↑").otherwise("↓"), "metric_name")
    rows = rows.join(metrics.select("metric_id", "metric_name"), "metric_id").groupBy("year", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))).alias("parts"))
    return rows.select("year", "cluster_id", F.array_join(F.transform("parts", lambda x: x["t"]), ", ").alias("label"))


def membership_attribution(features: DataFrame, clusters: DataFrame) -> DataFrame:
    """Exact Shapley values of "squared distance to the nearest other centroid minus that to the own": the score is a sum
    over metrics, so a metric's value is its term less the term's mean over the year's entities for the same centroids."""
    rows = features.select("entity", "year", "metric_id", F.col("z_value").alias("z"))
    means = cluster_profile(features, clusters)
    other = means.select("year", "metric_id", F.col("cluster_id").alias("c"), F.col("mean_z").alias("m"))
    sq = rows.join(clusters, ["entity", "year"]).join(other, ["year", "metric_id"]).where("c <> cluster_id").groupBy("entity", "year", "cluster_id", "c").agg(F.round(F.sum((F.col("z") - F.col("m")) ** 2), 8).alias("sq"))
    nearest = sq.groupBy("entity", "year", "cluster_id").agg(F.min_by("c", F.struct("sq", "c")).alias("near"))
    pairs = nearest.select("year", "cluster_id", "near").distinct()
    a, b = other.select("year", "metric_id", F.col("c").alias("cluster_id"), F.col("m").alias("own")), other.select("year", "metric_id", F.col("c").alias("near"), F.col("m").alias("far"))
    terms = pairs.join(a, ["year", "cluster_id"]).join(b, ["year", "near", "metric_id"])
    term = lambda z: (z - F.col("far")) ** 2 - (z - F.col("own")) ** 2
    stats = rows.groupBy("year", "metric_id").agg(F.avg("z").alias("mz"))
    base = terms.join(stats, ["year", "metric_id"]).withColumn("base", F.col("far") ** 2 - F.col("own") ** 2 - 2 * F.col("mz") * (F.col("far") - F.col("own")))
    found = rows.join(nearest, ["entity", "year"]).join(base, ["year", "cluster_id", "near", "metric_id"])
    return found.select("entity", "year", "metric_id", (term(F.col("z")) - F.col("base")).alias("value"))


def cluster_rank(dev: DataFrame, clusters: DataFrame, scheme: str) -> DataFrame:
    """(cluster_id, mean_score, rank): clusters by mean score, 0 the lowest."""
    rows = clusters.join(dev.where(F.col("scheme") == scheme), ["entity", "year"]).groupBy("cluster_id").agg(F.avg("total_score").alias("mean_score"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("mean_score", "cluster_id")) - 1)


def build_transitions(clusters: DataFrame, ranks: DataFrame) -> DataFrame:
    """From one available year to the next: clusters, their ranks, and the change of rank."""
    order = Window.partitionBy("entity").orderBy("year")
    rows = clusters.select("entity", F.lag("year").over(order).alias("year_from"), F.col("year").alias("year_to"), F.lag("cluster_id").over(order).alias("from_cluster"), F.col("cluster_id").alias("to_cluster")).where("year_from is not null")
    for k in ("from", "to"):
        rows = rows.join(F.broadcast(ranks.select(F.col("cluster_id").alias(f"{k}_cluster"), F.col("rank").alias(f"{k}_rank"))), f"{k}_cluster")
    return rows.withColumn("rank_delta", F.col("to_rank") - F.col("from_rank"))


def trajectory_descriptors(clusters: DataFrame, ranks: DataFrame) -> DataFrame:
    """(entity, initial_rank, final_rank, n_changes)."""
    rows = clusters.join(F.broadcast(ranks.select("cluster_id", "rank")), "cluster_id")
    changed = (F.col("cluster_id") != F.lag("cluster_id").over(Window.partitionBy("entity").orderBy("year"))).cast("long")
    rows = rows.withColumn("changed", F.coalesce(changed, F.lit(0)))
    return rows.groupBy("entity").agg(F.min_by("rank", "year").alias("initial_rank"), F.max_by("rank", "year").alias("final_rank"), F.sum("changed").alias("n_changes"))


def classify_trajectory(k: Column, leap: int = 2, volatile: int = 3) -> Column:
    """The type of a trajectory from initial_rank, final_rank and n_changes; the first rule that holds."""
    net = F.col("final_rank") - F.col("initial_rank")
    still = F.col("n_changes") == 0
    out = F.when(still & (F.col("final_rank") >= k - 1), "stable_high").when(still & (F.col("final_rank") == 0), "stable_low").when(still, "stable_mid")
    out = out.when((net >= leap) & (F.col("n_changes") <= 2), "leapfrogger").when(net >= leap, "converger").when(net <= -leap, "diverger")
    return out.when(F.col("n_changes") >= volatile, "volatile").otherwise("drifting")


def run_transitions(dev: DataFrame, clusters: DataFrame, scheme: str, leap: int = 2, volatile: int = 3) -> DataFrame:
    """Transitions, each with the type of its entity's trajectory."""
    ranks = cluster_rank(dev, clusters, scheme)
    kinds = trajectory_descriptors(clusters, ranks).crossJoin(F.broadcast(ranks.agg(F.count("*").alias("k"))))
    kinds = kinds.select("entity", classify_trajectory(F.col("k"), leap, volatile).alias("trajectory"))
    return build_transitions(clusters, ranks).join(kinds, "entity", "left")


def _unit(col: pd.Series) -> np.ndarray:
    """Profiles at length 1; a zero profile stays zero."""
    x = np.array(col.tolist(), dtype=np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _cosines(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Similarities at 8 decimals of the entities of ``a`` and ``b``; of an entity with itself -inf."""
    sim = np.round(_unit(a["profile"]) @ _unit(b["profile"]).T, 8) + 0.0
    sim[a["entity"].to_numpy()[:, None] == b["entity"].to_numpy()[None, :]] = -np.inf
    return sim


def _pack(x: np.ndarray) -> bytes:
    """Profiles as bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return (small if np.array_equal(small, x) else x).tobytes()


def _unpack(packed: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.float32 if len(packed) == 4 * n * width else np.float64).reshape(n, width).astype(np.float64)


def twin_blocks(profiles: DataFrame, top: int = 5, block: int = 512, pivots: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Blocks of profiles (year, own, names, x packed, width, floors), and the ordered pairs of blocks (year, i, j, met)
    with whether they have to meet.

    A year's entities go to the nearest of some of its profiles, chosen by hash, four for ``block`` entities and at most
    ``pivots``, and these cells are cut into blocks of at most about ``block``; zero profiles have cells of their own. A block knows its centre, its widest angle from it,
    its entities' ``top``-th similarities within the block (floors) and the least of them. No similarity between two blocks exceeds the
    cosine of the angle of their centres less both widest angles, so block i needn't meet j if that is below i's least.
    """
    tables = Tables(profiles.sparkSession)
    number = F.row_number().over(Window.partitionBy("year").orderBy(F.xxhash64("entity"), "entity"))
    first = profiles.withColumn("number", number).where(F.col("number") <= pivots)
    sizes = profiles.groupBy("year").agg(F.when(F.count("*") <= block, 1).otherwise(F.ceil(F.count("*") * 4 / block)).alias("most"))
    with shuffles_freed(profiles.sparkSession):
        chosen = first.join(sizes, "year").where(F.col("number") <= F.col("most")).select("year", "profile").toPandas()
    near = {year: _unit(rows["profile"]) for year, rows in chosen.groupby("year")}  # at most ``pivots`` profiles a year

    def assign(batches):
        for rows in batches:
            cell = np.zeros(len(rows), dtype=np.int64)
            for year, at in rows.groupby("year").indices.items():
                x = _unit(rows["profile"].iloc[at])
                cell[at] = np.where(x.any(axis=1), (x @ near[year].T).argmax(axis=1) + 1, 0)
            x = [np.asarray(v, dtype=np.float64) for v in rows["profile"]]
            yield pd.DataFrame({"entity": rows["entity"], "year": rows["year"], "x": [_pack(v) for v in x], "width": [len(v) for v in x], "cell": cell})

    cells = profiles.select("entity", F.col("year").cast("long").alias("year"), "profile").mapInPandas(assign, "entity string, year long, x binary, width int, cell long")
    cells = tables.put(cells)
    parts = cells.groupBy("year", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    rows = cells.join(parts, ["year", "cell"]).select("year", "entity", "x", "width", (F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("entity"), F.col("parts"))).alias("own"))

    def measure(key: tuple, a: pd.DataFrame) -> pd.DataFrame:
        a["profile"] = [_unpack(v, 1, n)[0] for v, n in zip(a.pop("x"), a["width"], strict=True)]
        x = _unit(a["profile"])
        centre = x.mean(axis=0)
        centre /= np.linalg.norm(centre) or 1.0
        widest = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        floors = np.partition(_cosines(a, a), len(a) - top, axis=1)[:, len(a) - top] if len(a) > top else np.full(len(a), -np.inf)
        packed = _pack(np.array(a["profile"].tolist(), dtype=np.float64))
        return pd.DataFrame({"year": [key[0]], "own": [key[1]], "names": [a["entity"].tolist()], "x": [packed], "width": [x.shape[1]], "floors": [floors.tolist()], "centre": [centre.tolist()], "widest": [widest], "least": [float(floors.min())]})

    known = tables.put(rows.groupBy("year", "own").applyInPandas(measure, "year long, own long, names array<string>, x binary, width int, floors array<double>, centre array<double>, widest double, least double"))
    tables.drop(cells)
    a, b = (known.select("year", "own", "centre", "widest", "least").alias(s) for s in "ab")
    cosine = F.expr("aggregate(zip_with(a.centre, b.centre, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) - F.col("a.widest") - F.col("b.widest")
    zero = (F.col("a.own") < 1 << 32) | (F.col("b.own") < 1 << 32)
    most = F.when(zero, 0.0).when(angle <= 0, 1.0).otherwise(F.cos(angle))
    # the margin covers the rounding of similarities and of angles
    met = (F.col("a.own") == F.col("b.own")) | (most + 1e-6 >= F.col("a.least"))
    pairs = a.join(b, F.col("a.year") == F.col("b.year")).select("a.year", F.col("a.own").alias("i"), F.col("b.own").alias("j"), met.alias("met"))
    return known.select("year", "own", "names", "x", "width", "floors"), pairs


def twin_block_report(profiles: DataFrame, top: int = 5, block: int = 512, pivots: int = 1024) -> DataFrame:
    """(year, pairs, met): the ordered pairs of blocks of a year, and those that have to meet."""
    pairs = twin_blocks(profiles, top, block, pivots)[1]
    return pairs.groupBy("year").agg(F.count("*").alias("pairs"), F.count_if("met").alias("met"))


class _Best:
    """The ``top`` best partners so far of each entity: similarities and ranks of names, best first."""

    def __init__(self, ranks: np.ndarray, floors: np.ndarray, top: int) -> None:
        self.ranks, self.top = ranks, top
        self.floors = floors - 2e-8  # a similarity of the same two may round another way in another product
        self.value, self.twin = np.full((len(ranks), top), -np.inf), np.full((len(ranks), top), np.iinfo(np.int64).max)

    def needed(self, at: slice | np.ndarray) -> np.ndarray:
        return np.maximum(self.floors[at], self.value[at, -1] - 1e-8)

    def offer(self, row: np.ndarray, other: np.ndarray, value: np.ndarray) -> None:
        """Take entities' partners ``other`` at unrounded similarities that reach what is ``needed``."""
        value, twin = np.round(value, 8) + 0.0, self.ranks[other]
        last = self.value[row, -1]
        keep = (twin != self.ranks[row]) & ((value > last) | ((value == last) & (twin < self.twin[row, -1])))
        if not keep.any():
            return
        row, twin, value = row[keep], twin[keep], value[keep]
        own = np.unique(row)
        row, twin, value = np.append(np.repeat(own, self.top), row), np.append(self.twin[own].ravel(), twin), np.append(self.value[own].ravel(), value)
        order = np.lexsort((twin, -value, row))
        row, twin, value = row[order], twin[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < self.top
        self.twin[row[first], place[first]], self.value[row[first], place[first]] = twin[first], value[first]


def _meet(top: int, cells: int = 1 << 20) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that lets the blocks of a tile meet, each two once for both, and gives each entity's best in the tile.

    A block meets as many others at once as make about ``cells`` similarities."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, met = [], set()
        for row in (row for batch in batches for row in batch.to_pylist()):
            if row["names"] is None:
                met |= {(min(pair["i"], pair["j"]), max(pair["i"], pair["j"])) for pair in row["met"]}
            else:
                blocks.append(row)
        known, ranks = np.unique(np.array([name for row in blocks for name in row["names"]], dtype=object), return_inverse=True)
        ends = np.cumsum([len(row["names"]) for row in blocks])
        at = {row["own"]: slice(end - len(row["names"]), end) for row, end in zip(blocks, ends, strict=True)}
        x = np.concatenate([_unpack(row["x"], len(row["names"]), row["width"]) for row in blocks])
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.where(norm == 0, 1, norm)
        best = _Best(ranks, np.array([floor for row in blocks for floor in row["floors"]]), top)
        partners: dict[int, list[int]] = {}
        for i, j in sorted(met):
            if i == j:  # they come first, as they leave least to look at in the others
                sim = x[at[i]] @ x[at[i]].T
                row, col = np.nonzero(sim >= best.needed(at[i])[:, None])
                best.offer(row + at[i].start, col + at[i].start, sim[row, col])
            else:
                partners.setdefault(i, []).append(j)
        for i, others in partners.items():
            own = x[at[i]]
            places = np.concatenate([np.arange(at[j].start, at[j].stop) for j in others])
            for part in np.array_split(places, -(-len(places) * len(own) // cells)):
                sim = own @ x[part].T
                row, col = np.nonzero(sim >= best.needed(at[i])[:, None])
                best.offer(row + at[i].start, part[col], sim[row, col])
                row, col = np.nonzero(sim >= best.needed(part)[None, :])
                best.offer(part[col], row + at[i].start, sim[row, col])
        for begin in range(0, len(ranks), 1 << 14):
            value, twin = best.value[begin : begin + (1 << 14)], best.twin[begin : begin + (1 << 14)]
            row, place = np.nonzero(value > -np.inf)
            columns = [pa.array(known[ranks[begin + row]], pa.string()), pa.array(np.full(len(row), key[0].as_py(), dtype=np.int64)), pa.array(known[twin[row, place]], pa.string()), pa.array(value[row, place])]
            yield pa.RecordBatch.from_arrays(columns, ["entity", "year", "twin", "similarity"])

    return run


def twins(profiles: DataFrame, top: int = 5, block: int = 512, pivots: int = 1024, group: int = 1 << 25) -> DataFrame:
    """(entity, year, rank, twin, similarity): the most similar profiles (entity, year, profile) of the same year.

    Cosine at 8 decimals, ties by entity; a zero profile has similarity 0. Blocks of like entities meet as matrices, unless
    bounds show that they can't bring a twin (``twin_blocks``). A year's blocks are dealt into groups of about ``group`` bytes
    of profiles at most; a task gets a tile of two groups and hands on each entity's ``top`` best, so neither a pair table
    nor a whole year is ever in one task, and a block is sent to a task for each group, not for each block that it meets.
    """
    tables = Tables(profiles.sparkSession)
    blocks, pairs = twin_blocks(profiles, top, block, pivots)
    size = F.size("names") * F.greatest("width", F.lit(1)) * 8.0
    squares = blocks.groupBy("year").agg(F.sum(size).alias("size")).agg(F.coalesce(F.sum(F.col("size") ** 2), F.lit(0.0))).first()[0]
    group = min(group, max(1.0, math.sqrt(squares / 32)))  # some 16 tiles at least, where the blocks allow it
    year = Window.partitionBy("year")
    before, total = F.sum(size).over(year.orderBy("own")) - size, F.sum(size).over(year)
    groups = tables.put(blocks.select("year", "own", F.floor(before * F.ceil(total / group) / total).alias("g")))
    for s in ("i", "j"):
        pairs = pairs.join(groups.select("year", F.col("own").alias(s), F.col("g").alias(f"g{s}")), ["year", s])
    met = tables.put(pairs.where("met").groupBy("year", F.least("gi", "gj").alias("p"), F.greatest("gi", "gj").alias("q")).agg(F.collect_list(F.struct("i", "j")).alias("met")))
    takes_part = met.select("year", "p", "q", F.explode(F.array_distinct(F.concat("met.i", "met.j"))).alias("own"))
    dealt = with_small(blocks, takes_part, ["year", "own"]).unionByName(met, allowMissingColumns=True).select("year", "p", "q", "own", "names", "x", "width", "floors", "met")
    n = met.count()
    found = dealt.repartition(max(1, min(n, max(256, n // 16))), "year", "p", "q").groupBy("year", "p", "q").applyInArrow(_meet(top), "entity string, year long, twin string, similarity double")
    order = Window.partitionBy("entity", "year").orderBy(F.col("similarity").desc(), "twin")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def twins_of(found: DataFrame, regions: DataFrame, entity: str, year: int) -> DataFrame:
    """An entity's twins with names and districts."""
    rows = found.where((F.col("entity") == entity) & (F.col("year") == year)).select("rank", "similarity", F.col("twin").alias("entity"))
    return rows.join(regions.select("entity", "region_name", "district"), "entity")


def region_vs_type(features: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per (entity, year, metric): the gap to the cluster's mean, the cluster's size, and the share of the other members
    that are strictly closer to the centre (null for a single member)."""
    far = centroid_distances(features, clusters).withColumn("distance", F.round("distance", 8))
    far = ranking.shared(far, "r", "n", "distance", "entity", "year", "cluster_id").withColumn("closer", F.col("r") - 1)
    far = far.select("entity", "year", "cluster_id", F.col("n").alias("cluster_size"), ratio(F.col("closer"), F.when(F.col("n") > 1, F.col("n") - 1)).alias("typicality"))
    rows = features.join(far, ["entity", "year"]).join(cluster_profile(features, clusters), ["year", "cluster_id", "metric_id"])
    return rows.select("entity", "year", "cluster_id", "metric_id", (F.col("z_value") - F.col("mean_z")).alias("gap"), "typicality", "cluster_size")


def train_typology_model(profiles: DataFrame, folds: int = 5, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """A random forest from profile (vector ``features``) to cluster_id, and its card: stratified cross-validated
    accuracy, number of samples, folds. A class's rows are dealt to the folds in turn, in the order of a hash; there are
    as many folds as the smallest class has rows, ``folds`` at most, and below two the accuracy is NaN."""
    rows = profiles.withColumn("label", F.col("cluster_id").cast("double")).withColumn("_h", F.xxhash64("entity", "year", F.lit(seed)))
    rows = checkpoint(ranking.ordinal(rows, "_r", "_h", "entity", "label"))
    stages = Pipeline(stages=[RandomForestClassifier(labelCol="label", numTrees=30, seed=seed)])
    folds = min(folds, rows.groupBy("label").count().agg(F.min("count")).first()[0] or 0)
    part = F.pmod(F.col("_r"), F.lit(max(folds, 1)))
    scored = [stages.fit(rows.where(part != f)).transform(rows.where(part == f)) for f in range(folds)] if folds >= 2 else []
    right = reduce(DataFrame.unionByName, scored).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("cv_accuracy")) if scored else rows.limit(1).select(F.lit(float("nan")).alias("cv_accuracy"))
    card = right.crossJoin(rows.agg(F.count("*").alias("n_samples"))).withColumn("folds", F.lit(folds).cast("long"))
    return stages.fit(rows), card


def predict_cluster(model: PipelineModel, profiles: DataFrame) -> DataFrame:
    """(entity, year, predicted) of profiles with a vector ``features``."""
    return model.transform(profiles).select("entity", "year", F.col("prediction").cast("long").alias("predicted"))


def save_typology_model(model: PipelineModel, folder: str, metric_ids: list[int], labels: DataFrame, card: DataFrame) -> None:
    """Write a fitted model with the order of metrics in its vectors, the names of its clusters (cluster_id, label) and
    its card. The file with the order comes last; without it the folder is no model."""
    model.write().overwrite().save(f"{folder}/model")
    labels.select(F.col("cluster_id").cast("long").alias("cluster_id"), "label").write.mode("overwrite").parquet(f"{folder}/labels")
    card.write.mode("overwrite").parquet(f"{folder}/card")
    put_text(labels.sparkSession, f"{folder}/order", "metrics", json.dumps([int(m) for m in metric_ids]))


def apply_typology_model(spark: SparkSession, folder: str, features: DataFrame) -> DataFrame:
    """(entity, year, predicted, label) by a saved model, of the entity-years of ``features`` (entity, year, metric_id,
    z_value) that have all its metrics; others have no row. Metrics that the model doesn't know are left out."""
    if not names(spark, f"{folder}/order"):
        raise ValueError(f"no model in {folder}")
    ids = json.loads(get_text(spark, f"{folder}/order", "metrics"))
    pairs = features.where(F.col("metric_id").isin(ids) & F.col("z_value").isNotNull()).groupBy("entity", "year").agg(F.map_from_entries(F.collect_list(F.struct("metric_id", "z_value"))).alias("m")).where(F.size("m") == len(ids))
    rows = pairs.select("entity", "year", array_to_vector(F.array(*[F.col("m")[F.lit(i).cast("long")] for i in ids])).alias("features"))
    found = predict_cluster(PipelineModel.load(f"{folder}/model"), rows)
    return found.join(spark.read.parquet(f"{folder}/labels").withColumnRenamed("cluster_id", "predicted"), "predicted", "left").select("entity", "year", "predicted", "label")


def typology_card(spark: SparkSession, folder: str) -> DataFrame:
    """The card of a saved model."""
    return spark.read.parquet(f"{folder}/card")
