"""Best-fit packing of a corpus after Martello-Toth dominance reduction, planned on the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint, width
from tessella.llm.packing import plan_packing
from tessella.llm.wordbpe import encoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
_SEGMENT = "length long, lo long, hi long, first long, per long, base long"


def pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents' ids, each with ``end_id`` after them, cut into pieces of ``capacity``: place, length, checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, end, step = encoder(vocabulary, "<u4"), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc, ids in zip(part.column(0).to_pylist(), codes.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    rows += [(doc, k, s // 4, (len(ids) - s if len(ids) - s < step else step) // 4, zlib.crc32(ids[s : s + step])) for k, s in enumerate(range(0, len(ids), step))]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(cut: DataFrame) -> DataFrame:
    """``cut`` with its rank (from 0) within its length; a length is numbered in hashed parts, so a hot one is spread."""
    parts = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(width(cut.sparkSession))))
    sizes = parts.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    return parts.withColumn("own", F.row_number().over(own)).join(sizes, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("part", "own", "before")


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece of every row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end token alone; a null doc_id is carried along; rows that share a doc_id are packed
    each; no rows give no rows; further columns are not looked at. The histogram of lengths, of at most ``capacity``
    rows, is all that reaches the driver; the plan goes back as a table of a few rows per length, which is broadcast.
    """
    spark = docs.sparkSession
    cut = checkpoint(pieces(docs, capacity, end_id, vocabulary))
    lengths = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(lengths, capacity)
    segments = F.broadcast(spark.createDataFrame(plan.segments, _SEGMENT))
    placed = ranked(cut).join(segments, "length").where("rank >= lo and rank < hi")
    place = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.expr("(rank - lo) div per")).alias("sequence_id"), (F.col("base") + F.pmod(place, F.col("per")) * F.col("length")).alias("offset"),
    )
