"""Sets of tables that are published as one: written under a new version, gated together, then named by one rename.

A folder holds ``versions/<version>/<table>`` and ``published/<number>``, small files with the name of a version; the
one of the highest number counts. A version is complete and checked before its file appears, and appears at once, so a
reader sees the old tables or the new ones, never some of both, and a failure on the way leaves the old ones published.
Versions are never written again once published; a DataFrame on an older one stays readable.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, folder: str) -> tuple[Any, Any]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def put_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A small file that appears whole: written aside, then renamed."""
    files, path = _files(spark, folder)
    at = spark._jvm.org.apache.hadoop.fs.Path
    aside = at(path.getParent(), f".{name}-{uuid.uuid4().hex}")
    files.mkdirs(path)
    out = files.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(aside, at(path, name)):
        raise OSError(f"could not name {folder}/{name}")


def names(spark: SparkSession, folder: str) -> list[str]:
    """The files of ``folder`` that ``put_text`` has named, in order; none without the folder."""
    files, path = _files(spark, folder)
    return sorted(n for n in (s.getPath().getName() for s in files.listStatus(path)) if not n.startswith(".")) if files.exists(path) else []


def get_text(spark: SparkSession, folder: str, name: str) -> str:
    return spark.read.text(f"{folder}/{name}", wholetext=True).first()[0]


@dataclass(frozen=True)
class Gate:
    """What a version must hold: its required tables, none empty; a number of entities; no older last year than before."""

    required: tuple[str, ...] = ("regions", "fact", "dev_index")
    entities: tuple[int, int] = (80, 100)
    entity_table: str = "regions"
    year_table: str = "fact"


def published_version(spark: SparkSession, folder: str) -> str | None:
    """The version that readers see, or None."""
    found = names(spark, f"{folder}/published")
    return json.loads(get_text(spark, f"{folder}/published", found[-1]))["version"] if found else None


def read_published(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the published version; an error if nothing is published."""
    version = published_version(spark, folder)
    if version is None:
        raise ValueError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/versions/{version}/{table}")


def write_version(spark: SparkSession, tables: dict[str, DataFrame], folder: str, version: str) -> None:
    """Write all tables under ``version``; what an attempt that failed left there is replaced, a published version never."""
    if version in {json.loads(get_text(spark, f"{folder}/published", n))["version"] for n in names(spark, f"{folder}/published")}:
        raise ValueError(f"version {version} is published already")
    files, path = _files(spark, f"{folder}/versions/{version}")
    files.delete(path, True)
    for name, df in tables.items():
        df.write.parquet(f"{folder}/versions/{version}/{name}")


def _last_year(spark: SparkSession, path: str) -> int | None:
    """The last year of a table; None where it has none or can't be read."""
    try:
        return spark.read.parquet(path).agg(F.max("year")).first()[0]
    except (PySparkException, Py4JJavaError):
        return None


def check_version(spark: SparkSession, folder: str, version: str, gate: Gate = Gate()) -> list[str]:
    """What keeps a written version from being published; nothing if all is well."""
    files, path = _files(spark, f"{folder}/versions/{version}")
    there = {s.getPath().getName() for s in files.listStatus(path)} if files.exists(path) else set()
    faults = [f"table {t} is missing" for t in gate.required if t not in there]
    read = lambda t: spark.read.parquet(f"{folder}/versions/{version}/{t}")
    faults += [f"table {t} is empty" for t in gate.required if t in there and read(t).isEmpty()]
    if faults:
        return faults
    n = read(gate.entity_table).select("entity").distinct().count()
    if not gate.entities[0] <= n <= gate.entities[1]:
        faults.append(f"{n} entities, not {gate.entities[0]} to {gate.entities[1]}")
    new, current = _last_year(spark, f"{folder}/versions/{version}/{gate.year_table}"), published_version(spark, folder)
    old = _last_year(spark, f"{folder}/versions/{current}/{gate.year_table}") if current else None
    if new is None:
        faults.append("no last year")
    elif old is not None and new < old:
        faults.append(f"last year {new} is before {old}")
    return faults


def point_to(spark: SparkSession, folder: str, version: str) -> None:
    """Let readers see ``version`` from now on."""
    found = names(spark, f"{folder}/published")
    put_text(spark, f"{folder}/published", f"{int(found[-1]) + 1 if found else 1:012d}", json.dumps({"version": version}))


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, version: str, gate: Gate = Gate()) -> list[str]:
    """Write, check and publish a version. Returns what kept it back; then the old version stays published."""
    write_version(spark, tables, folder, version)
    faults = check_version(spark, folder, version, gate)
    if not faults:
        point_to(spark, folder, version)
    return faults
