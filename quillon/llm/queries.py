"""One query per operator of this subpackage, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.alignment import alignment
from quillon.llm.common import table
from quillon.llm.embedding_dedup import vector_classes
from quillon.llm.fingerprints import with_edits
from quillon.llm.licenses import licence_spans
from quillon.llm.line_dedup import drop_repeated_runs
from quillon.llm.merkle import checked_manifest
from quillon.llm.mixing import with_copies
from quillon.llm.ngram_join import jaccard_classes
from quillon.llm.pieces import decode, with_pieces
from quillon.llm.pii import digest_columns, personal_data
from quillon.llm.quality import with_quality
from quillon.llm.sharding import placed
from quillon.llm.toxicity import REJECT_AT, training_fold, with_score


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_classes(table(spark, sf_dir, "embeddings"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "score", F.xxhash64("ids").alias("ids_hash"),
        F.transform("n_best", lambda x: x["score"]).alias("n_best_scores"),
        F.xxhash64(F.to_json("n_best")).alias("n_best_hash"),
        decode()(F.col("ids")).eqNullSafe(F.col("text")).alias("decoded_equal"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_repeated_runs(table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(personal_data(table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = ~training_fold(F.col("doc_id")) & F.col("doc_id").isNotNull()
    return docs.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= REJECT_AT).cast("int").alias("predicted")
    )


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "end", "name", "saved", F.array_join("missing", " ").alias("missing"),
        F.array_join("put_in", " ").alias("put_in"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_copies(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_manifest(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = alignment(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_line_dedup": op4_line_dedup,
    "op5_sharding": op5_sharding,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_license_scans": op8_license_scans,
    "op9_fingerprints": op9_fingerprints,
    "op10_source_mixing": op10_source_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_quality_rules": op12_quality_rules,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}
