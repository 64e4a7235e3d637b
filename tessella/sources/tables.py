"""Reading and checking raw files, storing tables, and the gate on a new snapshot."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.config import SENTINELS
from tessella.contracts import CANONICAL, enforce


def null_sentinels(df: DataFrame, codes=SENTINELS, column: str = "indicator_value") -> DataFrame:
    """``column`` with the codes as null; no codes change nothing."""
    return df.withColumn(column, F.when(~F.col(column).isin(*codes), F.col(column))) if codes else df


def sentinel_hits(df: DataFrame, codes=SENTINELS, column: str = "indicator_value") -> DataFrame:
    """One row: how many values of ``column`` are codes."""
    return df.agg(F.count_if(F.col(column).isin(*codes)).alias("hits") if codes else F.lit(0).cast("long").alias("hits"))


def read_canonical(spark: SparkSession, path: str, codes=()) -> DataFrame:
    """A raw long Parquet file as the canonical columns; extra columns go, missing ones are an error."""
    return null_sentinels(enforce(spark.read.parquet(path), CANONICAL), codes)


def read_sources(frames: list[DataFrame]) -> DataFrame:
    """All registered sources as one; none is an error."""
    if not frames:
        raise ValueError("no source is registered")
    return reduce(DataFrame.unionByName, [enforce(f, CANONICAL) for f in frames])


def check_incoming(spark: SparkSession, path: str) -> DataFrame:
    """One row: whether the file can be read and has all canonical columns, those it lacks, and its rows.

    A file that is missing or no Parquet is not ok, lacks all columns and has no rows.
    """
    try:
        df = spark.read.parquet(path)
    except (PySparkException, Py4JJavaError):
        df = spark.createDataFrame([], "unread int")
    missing = [c for c in CANONICAL if c not in df.columns]
    return df.agg(F.count("*").alias("rows")).select(F.lit(not missing).alias("ok"), F.lit(",".join(missing)).alias("missing"), "rows")


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """Replace table ``name`` in ``folder``."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables in ``folder``, by the session's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(path) if s.isDirectory())


#: A nested coordinate list is read as text and its numbers are paired, so any depth of nesting will do.
_FEATURES = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))])))])


def parse_vertices(raw: DataFrame, key: str = "entity") -> DataFrame:
    """(entity, x, y): the distinct vertices, at 6 decimals, of the features of GeoJSON texts in column ``value``."""
    features = raw.select(F.explode(F.from_json("value", _FEATURES)["features"]).alias("f"))
    numbers = F.transform(F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"), F.lit(1)), lambda s: s.cast("double"))
    pairs = F.transform(F.sequence(F.lit(1), (F.size("n") / 2).cast("int")), lambda i: F.struct(F.element_at("n", 2 * i - 1).alias("x"), F.element_at("n", 2 * i).alias("y")))
    rows = features.select(F.col("f.properties")[key].alias("entity"), numbers.alias("n")).where(F.size("n") > 1).select("entity", F.explode(pairs).alias("p"))
    return rows.select("entity", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y")).distinct()


def read_geojson_vertices(spark: SparkSession, path: str, key: str = "entity") -> DataFrame:
    return parse_vertices(spark.read.text(path, wholetext=True), key)


def validate_snapshot(new: DataFrame, current: DataFrame, low: int, high: int) -> DataFrame:
    """One row: rows, entities, last year of ``new`` and whether it may replace ``current`` (entity, year)."""
    last = current.agg(F.max("year").alias("published_year"))
    seen = new.agg(F.count("*").alias("rows"), F.countDistinct("entity").alias("entities"), F.max("year").alias("last_year"))
    ok = (F.col("rows") > 0) & F.col("entities").between(low, high) & (F.col("last_year") >= F.coalesce("published_year", "last_year"))
    return seen.crossJoin(last).withColumn("ok", F.coalesce(ok, F.lit(False)))
