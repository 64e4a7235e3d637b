"""Corpus pipeline: language ID, quality rules, near-duplicate removal, packing; each stage is written and reread.

Every stage but the last returns rows of ``documents`` with all their columns. Rows without a doc_id can't be told
apart and go in the first stage. Equal rows are one document: near-dedup leaves one of them. Rows of one doc_id that
differ share its verdict, which is to keep only if each of them is kept. Null and blank texts have no language and go;
an empty table gives an empty result; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.lineage import Tables
from tessella.llm import langid, neardup, pack_documents, quality


def _keep(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id has no row in ``verdict`` that isn't kept."""
    good = verdict.where("doc_id is not null").groupBy("doc_id").agg(F.every("kept").alias("kept")).where("kept")
    return docs.join(good, "doc_id", "left_semi").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without text or letters, or without a main language, go."""
    model = langid.fit(docs.where(~langid.held_out("doc_id", 4)))
    return _keep(docs, langid.identify(docs, model).select("doc_id", ((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).alias("kept")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted by frequent lines."""
    return _keep(docs, quality.quality(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every component of near-duplicates, once."""
    return _keep(docs, neardup.near_duplicates(docs)).dropDuplicates()


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of every document lies in the packed sequences."""
    return pack_documents.pack(docs)


STAGES = [("language_id", language), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("packing", packing)]

#: Language ID and components have no SQL; tests/llm compares all stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and reread.

    A stage's table is dropped when the next one is written; the last one stays for the result, which reads it.
    """
    docs, tables, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark), []
    for _, stage in STAGES[:-1]:
        docs = tables.put(stage(spark, docs, sf_dir))
        tables.drop(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
