"""Incremental intake of raw files that arrive in a folder, merged by key so that the newest edition stays.

The sink holds ``data/batch=<n>/part=<year>`` and ``manifests/<n>``, which names for each year the batch with its
current rows. A batch reads the years that it touches as they were, keeps the newest edition of each key, writes these
years anew under its own number, and then names them in its manifest, which appears whole. So a batch that fails on the
way leaves the rows of the last one, and a batch that is repeated after its manifest appeared changes nothing.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.contracts import CANONICAL, enforce
from tessella.operators.etl import dedup_latest
from tessella.sources.tables import null_sentinels
from tessella.sources.versions import get_text, names, put_text

_KINDS = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType()}
SCHEMA = T.StructType([T.StructField(c, _KINDS[t]) for c, t in CANONICAL.items()])
#: Rows of one key are editions of one value.
KEYS = ["object_level", "object_okato", "object_name", "indicator_code", "subsection", "year"]


def _manifest(spark: SparkSession, sink: str, before: int | None = None) -> dict[str, int]:
    """Year to batch, by the last manifest (before batch ``before``)."""
    found = [n for n in names(spark, f"{sink}/manifests") if before is None or int(n) < before]
    return json.loads(get_text(spark, f"{sink}/manifests", found[-1])) if found else {}


def _years(spark: SparkSession, sink: str, where: dict[str, int]) -> DataFrame:
    paths = [f"{sink}/data/batch={b}/part={y}" for y, b in sorted(where.items())]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def read_intake(spark: SparkSession, sink: str) -> DataFrame:
    """The merged rows as of the last batch; none before the first."""
    return _years(spark, sink, _manifest(spark, sink))


def merge_batch(batch: DataFrame, number: int, sink: str, codes=()) -> None:
    """Merge the rows of batch ``number`` into ``sink``; a batch that was merged before is left."""
    spark = batch.sparkSession
    if f"{number:012d}" in names(spark, f"{sink}/manifests"):
        return
    new = null_sentinels(enforce(batch, CANONICAL), codes)
    before, touched = _manifest(spark, sink, number), [r[0] for r in new.select(F.coalesce(F.col("year").cast("string"), F.lit("none"))).distinct().collect()]
    rows = reduce(DataFrame.unionByName, [_years(spark, sink, {y: before[y] for y in touched if y in before}), new])
    merged = dedup_latest(rows, KEYS).withColumn("part", F.coalesce(F.col("year").cast("string"), F.lit("none")))
    merged.write.mode("overwrite").partitionBy("part").parquet(f"{sink}/data/batch={number}")
    put_text(spark, f"{sink}/manifests", f"{number:012d}", json.dumps(before | dict.fromkeys(touched, number)))


def stream_intake(spark: SparkSession, folder: str, checkpoint: str, sink: str, codes=()) -> None:
    """Merge the files of ``folder`` that are new since the last call into ``sink``, each once."""
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    merge = lambda batch, number: merge_batch(batch, number, sink, codes)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
