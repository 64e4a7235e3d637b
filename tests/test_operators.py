"""Operators that SQL can't express, against brute force on small inputs, and the edge cases of tables."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessella.contracts import CANONICAL, enforce, validate_fact
from tessella.operators import etl, index, spatial, typology
from tessella.sources import tables


def panel(spark, profiles):
    """Features (entity, year, metric_id, z_value) of {(entity, year): profile}."""
    rows = [(e, y, m, float(z)) for (e, y), p in profiles.items() for m, z in enumerate(p)]
    return spark.createDataFrame(rows, "entity string, year long, metric_id long, z_value double")


def cost(profiles, labels):
    total = 0.0
    for key in {(y, c) for (_, y), c in labels.items()}:
        x = np.array([profiles[e, y] for (e, y), c in labels.items() if (y, c) == key])
        total += ((x - x.mean(axis=0)) ** 2).sum()
    return total


def test_clusters_of_three_clear_groups(spark):
    rng = np.random.default_rng(1)
    profiles = {(f"e{i:02d}", y): np.array([9.0 * (i % 3), -9.0 * (i % 3)]) + rng.normal(size=2) for i in range(30) for y in (2001, 2002)}
    found = {(r.entity, r.year): r.cluster_id for r in typology.cluster_by_period(panel(spark, profiles), 3).collect()}
    assert found == {(e, y): int(e[1:]) % 3 for e, y in profiles}
    best = typology.choose_k(panel(spark, profiles), range(2, 5)).collect()
    assert [r.k for r in best][0] == 3 and len(best) == 3


def test_clusters_are_no_dearer_than_the_best_single_start(spark):
    rng = np.random.default_rng(2)
    profiles = {(f"e{i:03d}", 2001): rng.normal(size=3) for i in range(120)}
    found = {(r.entity, r.year): r.cluster_id for r in typology.cluster_by_period(panel(spark, profiles), 5).collect()}
    rows = spark.createDataFrame([(p.tolist(),) for p in profiles.values()], "p array<double>").select(array_to_vector("p").alias("features"))
    assert cost(profiles, found) <= 1.03 * min(KMeans(k=5, seed=s).fit(rows).summary.trainingCost for s in range(3))


def test_few_profiles_and_a_small_year(spark):
    profiles = {("a", 2001): [0.0], ("b", 2001): [0.0], ("c", 2001): [5.0]}
    found = {r.entity: r.cluster_id for r in typology.cluster_by_period(panel(spark, profiles), 3).collect()}
    assert found == {"a": 0, "b": 0, "c": 1}
    with pytest.raises(ValueError):
        typology.choose_k(panel(spark, profiles), range(3, 5))


def test_aligned_labels_overlap_most(spark):
    rng = np.random.default_rng(3)
    rows = [(f"e{i}", y, int(rng.integers(4))) for i in range(40) for y in (1, 2, 3)]
    found = {(r.entity, r.year): r.cluster_id for r in typology.align_labels(spark.createDataFrame(rows, "entity string, year long, cluster_id long"), 4).collect()}
    given = {(e, y): c for e, y, c in rows}
    for y in (2, 3):
        kept = sum(found[e, y] == found[e, y - 1] for e, _ in {(e, 0) for e, _, _ in rows})
        assert kept == max(sum(p[given[f"e{i}", y]] == found[f"e{i}", y - 1] for i in range(40)) for p in permutations(range(4)))


def test_pca_weights_by_power_iteration(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) @ np.array([[2.0, 1.0, 0.5], [0.0, 1.0, 0.4], [0.0, 0.0, 0.3]])
    wide = spark.createDataFrame([(f"e{i}", 1, *map(float, r)) for i, r in enumerate(x)], "entity string, year long, a double, b double, c double")
    v = np.ones(3)
    for _ in range(500):
        v = np.cov(x.T) @ v
        v /= np.linalg.norm(v)
    found = index.scheme_weights(wide, ["a", "b", "c"], "pca")
    assert np.allclose([found[d] for d in "abc"], v / v.sum())


def test_moran_of_a_line_and_of_isolates(spark):
    dev = spark.createDataFrame([(f"e{i}", 1, "equal", float(i)) for i in range(8)] + [("far", 1, "equal", 3.0)], "entity string, year long, scheme string, total_score double")
    edges = spark.createDataFrame([(f"e{i}", f"e{i + k}") for i in range(8) for k in (-1, 1) if 0 <= i + k < 8], "src string, dst string")
    row = spatial.moran_significance(dev, edges, 199).first()
    assert row.moran_i > 0.5 and row.z_score > 2 and row.p_value < 0.02
    local = {r.entity: r for r in spatial.moran_local(dev, edges, 199).collect()}
    assert (local["far"].quadrant, local["far"].p_value, local["far"].n_neighbors) == ("ns", None, 0)
    # the end's only neighbour is the largest of 7 others that may be drawn, so 1 of 7 draws reaches it
    assert abs(local["e7"].p_value - 2 / 7) < 0.1 and local["e7"].quadrant == "ns" and len(local) == 9
    assert local["e7"].local_i > 0 and {r.quadrant for r in spatial.moran_local_parts(dev, edges).collect()} == {"HH", "LL", "ns"}
    flat = spatial.moran_significance(dev.replace({float(i): 1.0 for i in range(8)}, subset=["total_score"]), edges, 19).first()
    assert (flat.moran_i, flat.z_score) == (0.0, 0.0)


def test_missing_columns_and_empty_registry(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "raw"))
    with pytest.raises(ValueError, match="section.*version_date"):
        tables.read_canonical(spark, str(tmp_path / "raw"))
    with pytest.raises(ValueError):
        tables.read_sources([])
    assert enforce(spark.createDataFrame([], ", ".join(f"{c} string" for c in CANONICAL)), CANONICAL).count() == 0


def test_the_gate_on_facts_raises(spark):
    good = [("a", 1, 2000), ("a", 2, 2000)]
    kind = "entity string, metric_id long, year long"
    assert validate_fact(spark.createDataFrame(good, kind)).count() == 2
    for bad in (("a", 1, 2000), (None, 1, 2000), ("b", 1, 1800)):
        with pytest.raises(ValueError):
            validate_fact(spark.createDataFrame([*good, bad], kind))


def by_permutations(overlap):
    k = len(overlap)
    return list(max(permutations(range(k)), key=lambda p: (sum(overlap[p[c], c] for c in range(k)), tuple(-x for x in p))))


def test_assignment_is_the_best_of_all_permutations():
    rng = np.random.default_rng(8)
    for k in (1, 2, 3, 4, 5, 6):
        for top in (1, 3, 50):
            for _ in range(6):
                overlap = rng.integers(0, top, (k, k)) if top > 1 else np.zeros((k, k), int)
                assert typology.best_assignment(overlap) == by_permutations(overlap)
    one = rng.permutation(50)
    overlap = rng.integers(0, 20, (50, 50))
    overlap[one, np.arange(50)] = 1000
    assert typology.best_assignment(overlap) == one.tolist()


def test_assignment_of_unequal_numbers():
    assert typology.best_assignment(np.array([[0, 9, 0], [8, 0, 0]])) == [1, 0, 2]
    assert typology.best_assignment(np.array([[0, 9], [8, 0], [0, 7]])) == [1, 0]


def test_labels_beyond_k_are_an_error(spark):
    rows = [("a", 1, 0), ("a", 2, 3)]
    with pytest.raises(ValueError, match="label 3 is not one of 3"):
        typology.align_labels(spark.createDataFrame(rows, "entity string, year long, cluster_id long"), 3)


def test_euclidean_silhouette_in_blocks(spark):
    rng = np.random.default_rng(6)
    profiles = {(f"e{i:02d}", y): rng.normal(size=4) + 100 for i in range(40) for y in (1, 2)} | {("only", 3): [1.0], ("x", 4): [1.0], ("y", 4): [1.0]}
    labels = {(e, y): (5 if e == "e39" else int(e[1:]) % 3) if y < 3 else 0 for e, y in profiles}
    clusters = spark.createDataFrame([(e, y, c) for (e, y), c in labels.items()], "entity string, year long, cluster_id long")
    found = {r.year: r.silhouette for r in typology.euclidean_silhouette(panel(spark, profiles), clusters, block=9).collect()}
    for y in (1, 2):
        own = [e for e, t in profiles if t == y]
        values = []
        for e in own:
            mean = {}
            for c in set(labels.values()):
                far = [np.linalg.norm(profiles[e, y] - profiles[o, y]) for o in own if o != e and labels[o, y] == c]
                mean[c] = np.mean(far) if far else None
            a, b = mean.pop(labels[e, y]), min(m for m in mean.values() if m is not None)
            values.append(0.0 if a is None else (b - a) / max(a, b))
        assert abs(found[y] - np.mean(values)) < 1e-9
    assert found[3] is None and found[4] is None


def test_adjacency_with_hot_vertices(spark):
    """A vertex of all 60,000 entities pairs none of them; another one of 300 does so in blocks."""
    rows = [(f"e{k:05d}", "all") for k in range(60_000)] + [(f"e{k:05d}", f"v{j}") for k in range(60_000) for j in (k // 2, k // 3 + 10**6) if k < 9000]
    rows += [(f"h{k:03d}", v) for k in range(300) for v in ("hot", "warm" if k < 200 else f"own{k}")] + [("h000", "hot"), (None, "hot"), ("h001", None)]
    found = spatial.build_adjacency(spark.createDataFrame(rows, "entity string, vertex string"), block=64)
    got = {(r.src, r.dst) for r in found.collect()}
    own = {}
    for e, v in set(rows):
        if e and v and v not in ("all", "hot", "warm"):
            own.setdefault(v, set()).add(e)
    want = {(a, b) for s in own.values() for a in s for b in s if a != b}  # with the vertex of all, one more is enough
    want |= {(f"h{a:03d}", f"h{b:03d}") for a in range(200) for b in range(200) if a != b}
    assert got == want


def shuffled_rows(df):
    """Rows that the last action on ``df`` wrote to shuffles."""
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                total += node.metrics().apply("shuffleRecordsWritten").value()
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
    return total


@pytest.mark.parametrize("least,block", [(1, 4096), (2, 4096), (2, 37), (3, 37), (4, 100)])
def test_adjacency_against_counts(spark, least, block):
    """Common and rare vertices, with numbers as entities: pairs by plain counts of shared vertices."""
    rng = np.random.default_rng(least)
    share = np.concatenate([rng.uniform(0, 0.3, 12), [0.9, 1.0], np.full(60, 0.008)])
    has = rng.random((250, len(share))) < share
    rows = [(1000 - 3 * int(e), f"v{v}") for e, v in zip(*np.nonzero(has), strict=True)]
    common = has.astype(int) @ has.T.astype(int)
    want = {(1000 - 3 * a, 1000 - 3 * b) for a in range(250) for b in range(250) if a != b and common[a, b] >= least}
    got = [(r.src, r.dst) for r in spatial.build_adjacency(spark.createDataFrame(rows + rows[:50], "entity long, vertex string"), least, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_adjacency_shuffles_no_pairs(spark):
    """400 entities that all share vertices: of 159,600 rows found none is shuffled, only members are."""
    rows = [(e, v) for e in range(400) for v in range(20) if (e + v) % 3]
    found = spatial.build_adjacency(spark.createDataFrame(rows, "entity long, vertex long"))
    assert len(found.collect()) == 400 * 399
    assert shuffled_rows(found) < 1000


def test_twins_pruned_by_bounds(spark):
    """Groups of like profiles: most block pairs are left out and the twins are those of a plain loop; so with opposite, equal and zero ones."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    x = np.round(np.repeat(centres, 40, axis=0) + rng.normal(size=(480, 6)) * 0.03, 6)
    x[7], x[300], x[301] = 0, -x[0], x[302]
    rows = [(f"e{k:03d}", 2000 + k % 2, v.tolist()) for k, v in enumerate(x)]
    data = spark.createDataFrame(rows, "entity string, year int, profile array<double>")
    got: dict = {}
    for r in typology.twins(data, 3, 64).orderBy("entity", "rank").collect():
        got.setdefault((r.entity, r.year), []).append((r.twin, r.similarity))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(norm == 0, 1, norm)
    sim = np.round(unit @ unit.T, 8) + 0.0
    for k, (name, year, _) in enumerate(rows):
        want = sorted((-sim[k, j], rows[j][0]) for j in range(len(rows)) if j != k and rows[j][1] == year)[:3]
        assert [(t, pytest.approx(s, abs=1e-8)) for t, s in got[name, year]] == [(t, -s) for s, t in want]
    report = typology.twin_block_report(data, 3, 64).collect()
    assert len(report) == 2 and all(r.met < 0.6 * r.pairs for r in report), report


def test_twins_with_ties_and_zero_profiles(spark):
    rng = np.random.default_rng(9)
    profiles = {f"e{k:02d}": [float(v) for v in rng.integers(0, 2, 3)] for k in range(40)}
    rows = spark.createDataFrame([(e, 1, p) for e, p in profiles.items()] + [("alone", 2, [1.0, 0.0, 0.0])], "entity string, year long, profile array<double>")
    got = {}
    for r in typology.twins(rows, 5, 7).collect():
        got.setdefault(r.entity, []).append((r["rank"], r.twin, r.similarity))
    unit = {e: np.array(p) / (np.linalg.norm(p) or 1) for e, p in profiles.items()}
    for e in profiles:
        best = sorted((-round(float(unit[e] @ unit[o]), 8), o) for o in profiles if o != e)[:5]
        assert sorted(got[e]) == [(k + 1, o, -s + 0.0) for k, (s, o) in enumerate(best)]
    assert "alone" not in got


@pytest.mark.parametrize("group,single", [(1 << 25, True), (600, True), (600, False)])
def test_twins_in_tiles(spark, group, single):
    """Small groups, so that an entity's twins come from many tiles; equal profiles and zero ones; single and double precision."""
    rng = np.random.default_rng(11)
    x = rng.integers(-2, 3, (150, 3)).astype(float) if single else rng.normal(size=(150, 3))
    x[40:44] = x[0]
    rows = [(f"e{k:03d}", 2000 + k % 2, v.tolist()) for k, v in enumerate(x)]
    found = typology.twins(spark.createDataFrame(rows, "entity string, year int, profile array<double>"), 5, 8, 1024, group)
    got: dict = {}
    for r in found.orderBy("entity", "rank").collect():
        got.setdefault(r.entity, []).append((r.twin, r.similarity))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(norm == 0, 1, norm)
    sim = np.round(unit @ unit.T, 8) + 0.0
    for k, (name, year, _) in enumerate(rows):
        want = sorted((-sim[k, j], rows[j][0]) for j in range(len(rows)) if j != k and rows[j][1] == year)[:5]
        assert [(t, pytest.approx(s, abs=1e-8)) for t, s in got[name]] == [(t, -s) for s, t in want]


def test_twins_shuffle_a_block_once_a_group(spark):
    """2000 profiles in some 250 blocks: rows shuffled are those of groups and of their best, not of pairs of blocks."""
    x = np.random.default_rng(3).normal(size=(2000, 8))
    found = typology.twins(spark.createDataFrame([(f"e{k:04d}", 1, v.tolist()) for k, v in enumerate(x)], "entity string, year int, profile array<double>"), 5, 32)
    assert len(found.collect()) == 10_000
    assert shuffled_rows(found) < 80_000


def test_saved_typology_model(spark, tmp_path):
    rng = np.random.default_rng(7)
    profiles = {(f"e{i:02d}", y): np.array([6.0 * (i % 2), 1.0, -6.0 * (i % 2)]) + rng.normal(size=3) for i in range(30) for y in (1, 2)}
    features = panel(spark, profiles).withColumn("metric_id", F.col("metric_id") + 7)
    rows = features.groupBy("entity", "year").agg(F.array_sort(F.collect_list(F.struct("metric_id", "z_value"))).alias("p"))
    rows = rows.select("entity", "year", array_to_vector(F.transform("p", lambda x: x["z_value"])).alias("features"), F.pmod(F.substring("entity", 2, 2).cast("long"), F.lit(2)).alias("cluster_id"))
    model, card = typology.train_typology_model(rows)
    labels = spark.createDataFrame([(0, "low"), (1, "high")], "cluster_id int, label string")
    folder = str(tmp_path / "model")
    with pytest.raises(ValueError):
        typology.apply_typology_model(spark, folder, features)
    typology.save_typology_model(model, folder, [7, 8, 9], labels, card)
    other = spark.newSession()
    assert other.read.parquet(f"{folder}/card").first().asDict() == {"cv_accuracy": 1.0, "n_samples": 60, "folds": 5}
    extra = features.unionByName(spark.createDataFrame([("e00", 1, 99, 5.0), ("part", 1, 7, 1.0)], features.schema))
    got = {(r.entity, r.year): (r.predicted, r.label) for r in typology.apply_typology_model(other, folder, extra).collect()}
    assert got == {(e, y): (int(e[1:]) % 2, ["low", "high"][int(e[1:]) % 2]) for e, y in profiles}
    small = rows.where("cluster_id = 0").unionByName(rows.where("entity = 'e01' and year = 1"))
    assert np.isnan(typology.train_typology_model(small)[1].first().cv_accuracy)


def test_incoming_files_that_are_none(spark, tmp_path):
    (tmp_path / "text.parquet").write_text("no parquet")
    for path in ("text.parquet", "nowhere"):
        row = tables.check_incoming(spark, str(tmp_path / path)).first()
        assert (row.ok, row.missing, row.rows) == (False, ",".join(CANONICAL), 0)


def test_names_keep_repeated_words(spark):
    rows = spark.createDataFrame([("The Republic of Baden Baden (map)",), ("baden-baden",), (None,)], "n string")
    assert [r[0] for r in rows.select(etl.normal_name("n")).collect()] == ["baden baden", "baden baden", None]
