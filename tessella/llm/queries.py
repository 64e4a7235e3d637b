"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import ann, byte_bpe, chat, langid, lexical, licences, lm_score, merkle, neardup, pack_documents, pack_matrix, quality, spotsigs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a Jaccard similarity of 0.75 on five-word shingles."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the cross-document line rule over all documents."""
    return quality.quality(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of every document, learnt from those not held out."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out("doc_id", 4))
    model = langid.fit(docs.where("not held_out"))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out("doc_id", 4).alias("held_out"), "lang_pred", "score", "n_langs")


def op4_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrix rows of all documents, with checksums in place of the ids and positions."""
    rows = pack_matrix.packed_rows(_table(spark, sf_dir, "documents"))
    return rows.select("sequence_id", "n_tokens", "n_segments", "doc_ids", "pieces", "starts", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each vector whose id is divisible by 50."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    rows = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents that name a licence, with its family."""
    return licences.scan(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    return pack_documents.pack(_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document by context mixing and by unigrams, learnt from those not held out."""
    docs = _table(spark, sf_dir, "documents")
    found = lm_score.score(docs, ~langid.held_out("doc_id", 7))
    return found.withColumn("held_out", langid.held_out("doc_id", 7))


def op10_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as each of its participants sees it, turn by turn."""
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best of all documents for each benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether the proof holds for a tampered text."""
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they and the next document's are."""
    return spotsigs.edited_fingerprints(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_quality_rules, op3_language_id, op4_token_matrices, op5_nearest_neighbours, op6_byte_bpe, op7_licence_scan, op8_best_fit_packing, op9_lm_scoring, op10_chat_perspectives, op11_ranked_search, op12_merkle_manifest, op13_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.quality_sql(), "op10_chat_perspectives": chat.perspectives_sql(), "op11_ranked_search": lexical.search_sql(), "op12_merkle_manifest": merkle.manifest_sql()}
