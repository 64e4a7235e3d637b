"""Merging intake and versioned publication: later and older editions, replays, crashes, readers, gates."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.contracts import CANONICAL
from tessella.sources import versions
from tessella.streaming import intake

KINDS = ", ".join(f"{c} {t}" for c, t in CANONICAL.items())


def raw(spark, *rows):
    """Rows (okato, code, year, value, source)."""
    base = dict.fromkeys(CANONICAL)
    full = [base | {"object_okato": o, "indicator_code": c, "year": y, "indicator_value": v, "source": s, "object_level": "region"} for o, c, y, v, s in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], KINDS)


def held(spark, sink):
    return {(r.object_okato, r.indicator_code, r.year): (r.indicator_value, r.source) for r in intake.read_intake(spark, sink).collect()}


def test_the_newest_edition_stays(spark, tmp_path):
    inbox, state, sink = (str(tmp_path / x) for x in ("in", "state", "out"))
    assert intake.read_intake(spark, sink).count() == 0
    take = lambda *rows: (raw(spark, *rows).write.mode("append").parquet(inbox), intake.stream_intake(spark, inbox, state, sink, (-9.0,)))
    take(("a", "x", 2001, 1.0, "ed 2019"), ("a", "x", 2002, 2.0, "ed 2019"), ("b", "x", 2001, 3.0, "ed 2019"), ("n", "x", None, -9.0, None))
    first = held(spark, sink)
    assert first[("a", "x", 2001)] == (1.0, "ed 2019") and first[("n", "x", None)] == (None, None) and len(first) == 4
    open_before = intake.read_intake(spark, sink)
    take(("a", "x", 2001, 10.0, "ed 2021"), ("b", "x", 2001, 30.0, "ed 2018"), ("c", "x", 2003, 4.0, None), ("c", "x", 2003, 5.0, "ed 2020"))
    assert held(spark, sink) == first | {("a", "x", 2001): (10.0, "ed 2021"), ("c", "x", 2003): (5.0, "ed 2020")}
    assert open_before.count() == 4  # who reads the older state still can
    intake.stream_intake(spark, inbox, state, sink)
    assert len(versions.names(spark, f"{sink}/manifests")) == 2  # nothing new, no batch


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    sink = str(tmp_path / "out")
    one, two = raw(spark, ("a", "x", 2001, 1.0, "ed 2019")), raw(spark, ("a", "x", 2001, 2.0, "ed 2020"), ("b", "y", 2001, 7.0, None))
    intake.merge_batch(one, 0, sink)
    # a batch that wrote its rows and failed before its manifest: readers keep the old rows, the repetition replaces them
    raw(spark, ("z", "z", 2001, 0.0, "half")).withColumn("part", F.lit("2001")).write.partitionBy("part").parquet(f"{sink}/data/batch=1")
    assert held(spark, sink) == {("a", "x", 2001): (1.0, "ed 2019")}
    intake.merge_batch(two, 1, sink)
    after = held(spark, sink)
    assert after == {("a", "x", 2001): (2.0, "ed 2020"), ("b", "y", 2001): (7.0, None)}
    intake.merge_batch(two, 1, sink)
    assert held(spark, sink) == after
    intake.merge_batch(one, 2, sink)  # the older edition comes again, in a later batch
    assert held(spark, sink) == after
    intake.merge_batch(raw(spark), 3, sink)
    assert held(spark, sink) == after


def snapshot(spark, last, entities=3, **others):
    regions = spark.createDataFrame([(f"e{k}",) for k in range(entities)], "entity string")
    fact = spark.createDataFrame([(f"e{k}", y) for k in range(2) for y in range(2000, last + 1)], "entity string, year long")
    return {"regions": regions, "fact": fact, "dev_index": fact} | others


GATE = versions.Gate(entities=(2, 5))


def test_publication(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert versions.published_version(spark, folder) is None
    with pytest.raises(ValueError):
        versions.read_published(spark, folder, "fact")
    assert versions.publish(spark, snapshot(spark, 2003), folder, "v1", GATE) == []
    reader = versions.read_published(spark, folder, "fact")
    none = spark.createDataFrame([], "entity string, year long")
    refused = {
        "missing": {k: v for k, v in snapshot(spark, 2004).items() if k != "dev_index"}, "empty": snapshot(spark, 2004, fact=none), "old": snapshot(spark, 2002),
        "few": snapshot(spark, 2004, entities=1), "many": snapshot(spark, 2004, entities=9), "yearless": snapshot(spark, 2004, fact=spark.createDataFrame([("e0", None)], "entity string, year long")),
    }
    said = {v: versions.publish(spark, t, folder, v, GATE) for v, t in refused.items()}
    assert said == {
        "missing": ["table dev_index is missing"], "empty": ["table fact is empty"], "old": ["last year 2002 is before 2003"],
        "few": ["1 entities, not 2 to 5"], "many": ["9 entities, not 2 to 5"], "yearless": ["no last year"],
    }
    assert versions.published_version(spark, folder) == "v1" and versions.read_published(spark, folder, "fact").count() == 8
    assert versions.publish(spark, snapshot(spark, 2003, entities=4), folder, "v2", GATE) == []  # as new as the old one
    assert versions.read_published(spark, folder, "regions").count() == 4 and reader.count() == 8
    with pytest.raises(ValueError):
        versions.publish(spark, snapshot(spark, 2005), folder, "v2", GATE)


def test_a_crash_before_the_pointer_moves(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    versions.publish(spark, snapshot(spark, 2003), folder, "v1", GATE)

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "point_to", fails)
        with pytest.raises(OSError):
            versions.publish(spark, snapshot(spark, 2004), folder, "v2", GATE)
    assert versions.read_published(spark, folder, "fact").agg(F.max("year")).first()[0] == 2003
    # one of the tables can't be computed: the version stays half written, and unseen
    broken = snapshot(spark, 2005)
    broken["dev_index"] = broken["fact"].withColumn("year", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        versions.publish(spark, broken, folder, "v2", GATE)
    assert versions.published_version(spark, folder) == "v1"
    assert versions.publish(spark, snapshot(spark, 2004), folder, "v2", GATE) == []
    assert versions.read_published(spark, folder, "fact").agg(F.max("year")).first()[0] == 2004


def test_a_broken_published_version_may_be_replaced(spark, tmp_path):
    folder = str(tmp_path / "store")
    versions.publish(spark, snapshot(spark, 2003), folder, "v1", GATE)
    (tmp_path / "store/versions/v1/fact").rename(tmp_path / "gone")
    assert versions.publish(spark, snapshot(spark, 2001), folder, "v2", GATE) == []
