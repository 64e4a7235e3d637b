"""Blocked Gram matrices and the correlations that they give, against numpy."""

from __future__ import annotations

import numpy as np

from tessella.functions.gram import gram
from tessella.operators.ranks import metric_correlations


def test_gram_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = {1: rng.normal(size=(40, 7)), 2: rng.normal(size=(30, 5)), 3: rng.normal(size=(2, 1))}
    rows = spark.createDataFrame([(k, v.tolist()) for k, own in x.items() for v in own], "key long, x array<double>").repartition(5)
    got = {(r.key, r.i, r.j): r.g for r in gram(rows, block=3, held=2).collect()}
    want = {(k, i, j): float(own[:, i] @ own[:, j]) for k, own in x.items() for i in range(own.shape[1]) for j in range(i + 1, own.shape[1])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert gram(rows.where("false")).count() == 0


def test_correlations_of_a_thousand_metrics(spark):
    """No row for each pair of metrics of an entity; one metric is constant, one entity lacks a metric."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 1000))
    x[:, 17] = 3.0
    rows = [(f"e{e:02d}", 2001, m, float(v)) for e, own in enumerate(x) for m, v in enumerate(own) if (e, m) != (59, 4)]
    features = spark.createDataFrame(rows, "entity string, year long, metric_id long, value_harmonized double")
    found = metric_correlations(features, "pearson", 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    got = {(r.metric_a, r.metric_b): (r.r, r.n) for r in found.collect()}
    keep = [m for m in range(1000) if m != 17]
    want = np.corrcoef(x[:59, keep].T)
    assert len(got) == 999 * 998 // 2 and {n for _, n in got.values()} == {59}
    assert max(abs(got[keep[i], keep[j]][0] - want[i, j]) for i in range(0, 999, 13) for j in range(i + 1, 999)) < 1e-12
