"""Isolation forests grown and met in tasks: planted outliers, plain walks over the same trees, saved models, edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.config import VALUE_TYPES
from tessella.contracts import ANOMALIES
from tessella.operators import anomalies, features

KIND = "entity string, year long, profile array<double>"


@pytest.fixture(scope="module")
def cloud(spark):
    """A dense cloud with far points in two years, a year of two rows, a year of equal rows."""
    rng = np.random.default_rng(1)
    rows = [(f"e{k:03d}", y, rng.normal(size=3).tolist()) for k in range(200) for y in (1, 2)] + [(f"far{k}", y, [30.0 + k, -40.0, 25.0]) for k in range(4) for y in (1, 2)]
    return spark.createDataFrame(rows + [(f"e{k}", 3, [float(k)] * 3) for k in range(2)] + [(f"e{k}", 4, [1.0, 2.0, 3.0]) for k in range(9)], KIND).repartition(5).cache()


def walked(tree, x):
    node = 0
    while tree.feature[node] >= 0:
        node = tree.under[node] if x[tree.feature[node]] < tree.cut[node] else tree.over[node]
    return tree.path[node]


def test_outliers_of_each_year(cloud):
    got = {(r.entity, r.year): r for r in anomalies.spatial_outliers(cloud).collect()}
    assert {y for _, y in got} == {1, 2, 4} and len(got) == 417  # the year of two rows is skipped
    for y in (1, 2):
        own = {e: r for (e, t), r in got.items() if t == y}
        assert {e for e, _ in sorted(((e, r.score) for e, r in own.items()), key=lambda v: v[1])[:4]} == {f"far{k}" for k in range(4)}
        assert all(own[f"far{k}"].is_anomaly for k in range(4)) and 0.03 < np.mean([r.is_anomaly for r in own.values()]) < 0.07
    assert not any(r.is_anomaly for (_, y), r in got.items() if y == 4)
    again = {(r.entity, r.year): r for r in anomalies.spatial_outliers(cloud.repartition(3)).collect()}
    assert again == got


def test_scores_are_those_of_plain_walks(spark, cloud, tmp_path):
    rows = cloud.where("year < 3")
    model = anomalies.train_anomaly_model(rows, trees=20, sample=64, pool=150)
    trees, x = model.collect(), {(r.entity, r.year): r.profile for r in rows.collect()}
    assert len(trees) == 20 and max(len(t.feature) for t in trees) <= 2 * 64 - 1
    raw = {k: -(2.0 ** (-np.mean([walked(t, p) for t in trees]) / trees[0].norm)) for k, p in x.items()}
    offset = np.quantile(list(raw.values()), 0.05)
    scored = anomalies.score_anomalies(rows, model)
    assert all(abs(r.score - (raw[r.entity, r.year] - offset)) < 1e-9 and r.is_anomaly == (r.score < 0) for r in scored.collect())
    anomalies.save_anomaly_model(model, str(tmp_path / "m"), scored)
    loaded, card = anomalies.load_anomaly_model(spark.newSession(), str(tmp_path / "m"))
    assert card.first().n_samples == 408 and 0.03 < card.first().anomaly_share < 0.07
    new = spark.createDataFrame([("in", 9, [0.1, 0.0, -0.1]), ("out", 9, [90.0, -90.0, 90.0])], KIND)
    found = {r.entity: r for r in anomalies.score_anomalies(new, loaded).collect()}
    assert found["out"].is_anomaly and not found["in"].is_anomaly and found["out"].score < found["in"].score


def test_scores_do_not_depend_on_the_order_of_trees(spark, cloud):
    rows = cloud.where("year < 3").withColumn("g", F.lit(0).cast("long"))
    forest = anomalies._forest(rows, 60, 64, 150, 42)
    trees, kind = sorted(forest.collect(), key=lambda r: r.t), forest.schema
    scores = [{(r.entity, r.year): r.raw for r in anomalies._raw_scores(rows, spark.createDataFrame(own, kind).coalesce(1)).collect()} for own in (trees, trees[::-1])]
    assert scores[0] == scores[1]


def test_union_and_predictions(spark, cloud):
    outliers = anomalies.spatial_outliers(cloud.where("year = 1"), trees=10)
    breaks = spark.createDataFrame([("a", 1, 2001, 3.0), ("b", 1, 2001, 9.0)], "entity string, metric_id long, year long, score double")
    changes = spark.createDataFrame([(1, 2001, 0.7)], "metric_id long, year long, score double")
    rows = anomalies.run_anomalies(outliers, breaks, changes).collect()
    assert list(rows[0].asDict()) == list(ANOMALIES)
    order = [(r.kind, r.year, -r.score) for r in rows]
    assert order == sorted(order) and {k for k, _, _ in order} == {"spatial_outlier", "structural_break", "methodology_change"}
    model = anomalies.train_anomaly_model(cloud.where("year = 1"), trees=10)
    some = spark.createDataFrame([("far0", 1, [30.0, -40.0, 25.0]), ("short", 1, [1.0]), ("null", 1, [1.0, None, 2.0])], KIND)
    types = spark.createDataFrame([("far0", 1, 2, "high")], "entity string, year long, predicted long, label string")
    row = anomalies.predict_profiles(some, 3, model, types).collect()
    assert [(r.entity, r.is_anomaly, r.predicted, r.label) for r in row] == [("far0", True, 2, "high")]
    bare = anomalies.predict_profiles(some, 3, None, None).first()
    assert (bare.entity, bare.score, bare.is_anomaly, bare.predicted) == ("far0", None, None, None)


def test_units_name_value_types(spark):
    units = ["в процентах к предыдущему году", "В ПРОЦЕНТАХ К ИТОГУ", "человек на 1000 человек населения", "разводов на 1000 браков", "на один рубль", "тонн", None, " ND ", "на 100 000 человек"]
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(units)], "k int, u string")
    got = [r.t for r in rows.select("k", features.classify_value_type("u").alias("t")).orderBy("k").collect()]
    assert got == ["rate_yoy", "share", "per_capita", "rate", "index", "absolute", "absolute", "absolute", "per_capita"]
    assert len(VALUE_TYPES) == 32


def test_coverage_of_nothing_is_an_error(spark):
    fact = spark.createDataFrame([("a", 1, 2001, 1.0)], "entity string, metric_id long, year long, value double")
    regions = spark.createDataFrame([("a", True), ("b", False)], "entity string, included boolean")
    assert features.compute_coverage(fact, regions, (2001, 2004)).first().coverage == 0.25
    for own, years in ((regions.where("not included"), (2001, 2004)), (regions, (2004, 2001))):
        with pytest.raises(ValueError):
            features.compute_coverage(fact, own, years)
