"""Cutting the lineage of a plan with reliable checkpoints and written tables in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, as the session's ``spark.checkpoint.dir`` names it.

    Where the session names none, a local master (tests on one machine) gets a fresh folder; a cluster is refused, as
    its executors don't see the driver's temporary folder.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the executions within go when each of them ends, not when the driver collects its garbage."""
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.checkpoint()


class Tables:
    """Intermediate tables of one job, written to the shared folder and dropped as soon as they have served."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame, **options: str) -> DataFrame:
        """``df`` as it reads from its written table; ``options`` go to the writer."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        with shuffles_freed(self.spark):
            df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._table = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``put`` gave; plans that read them can't be run any more."""
        for table in tables:
            self._delete(table._table)

    def clear(self) -> None:
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
