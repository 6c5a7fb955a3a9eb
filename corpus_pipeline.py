"""From raw documents to packed training sequences.

Each stage reads what its predecessor kept and is written before the next one begins; then its predecessor's table goes. All
but the last return the columns of ``documents``, whatever these are besides doc_id and text. Rows are judged each by their own
text, repeated ones alike; an empty table gives an empty result at every stage:

1. quality classifier: documents scored below one half go; null and empty texts are scored by their structure;
2. n-gram Jaccard join (five words, 0.8): of each group of near copies the rows with the least doc_id stay; null and empty
   texts, and rows without a doc_id, link with nothing here and stay;
3. benchmark decontamination: documents that contain a benchmark item go; null and empty texts contain none;
4. secret scans: secrets are replaced by a mark, every document stays; null texts stay null;
5. best-fit packing: the pieces with their sequences and offsets; a null or empty text is the end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.catalog import crc_fold, table, tokenizer_file
from corvane.llm.decontaminate import decontaminate
from corvane.llm.ngram_join import ngram_components
from corvane.llm.packing import best_fit_pack
from corvane.llm.quality_model import fit_quality, quality_filter
from corvane.llm.secret_scan import redacted
from corvane.llm.store import dropped, settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs, fit_quality(docs, table(spark, sf_dir, "labels"), crc_fold("doc_id", 3) != 1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = ngram_components(docs.where("doc_id is not null"), size=5, percent=80).where("doc_id <> component_id")
    return docs.join(copies.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_pack(docs, tokenizer_file())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: The classifier, the minimum hashes and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents under ``sf_dir`` that all stages keep."""
    docs, kept = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, last = settled(stage(spark, docs, sf_dir), name.replace(" ", "-")), kept
        if last is not None:
            dropped(last)
        kept = docs
    return STAGES[-1][1](spark, docs, sf_dir)
