"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.context_mixing import score_texts
from corvane.llm.decontaminate import contained_items
from corvane.llm.license_scan import fit_licenses, license_scan
from corvane.llm.ngram_join import ngram_components
from corvane.llm.packing import best_fit_pack
from corvane.llm.quality_model import crc_fold, fit_quality, quality_scores
from corvane.llm.quality_rules import quality_rules
from corvane.llm.secret_scan import digest, secret_scan
from corvane.llm.store import lean
from corvane.llm.substring_dedup import remove_repeats
from corvane.llm.toxicity import fit_toxicity, toxicity_scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(frame: DataFrame, held_out) -> DataFrame:
    return frame.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_fold("doc_id", 3) == 1
    return scored(quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out)), held_out)


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_fold("doc_id", 5) == 1
    return score_texts(table(spark, sf_dir, "documents"), ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secret_scan(table(spark, sf_dir, "documents")))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op6_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_fold("doc_id", 5) == 0
    return scored(toxicity_scores(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)), held_out)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan(docs, fit_licenses(docs))


def op9_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_quality_classifier, op2_context_mixing, op3_ngram_jaccard_join, op4_secret_scan, op5_best_fit_packing, op6_toxicity_neighbours, op7_substring_dedup, op8_license_scan, op9_benchmark_containment, op10_quality_rules, pipeline)}


def oracle_sql():
    return {}
