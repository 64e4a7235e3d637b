"""Every registered panel query against its SQL in DuckDB; those without SQL must give rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tessella.plans import queries as panel

SF = os.environ.get("PANEL_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 3) + 0.0
    return value


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 0.0011)


@pytest.mark.parametrize("name", sorted(panel.QUERIES))
def test_query(spark, duck, name):
    got = panel.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=str)
    if name not in panel.SQL:
        assert rows
        return
    found = duck.sql(panel.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
    assert len(rows) == len(want)
    assert all(same(x, y) for r, w in zip(rows, want, strict=True) for x, y in zip(r, w, strict=True)), (rows[:3], want[:3])
