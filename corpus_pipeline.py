"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it works on all rows that its
predecessor kept, and all but the last return the columns of ``docs``.  :func:`run` writes what a
stage returns as Parquet in the shared folder and reads it back as the next stage's input, so a lost
executor or a failed job costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnstore.llm import near_copies, packing, pii, quality_rules, suffix_dedup
from cairnstore.llm.common import documents, small_batches, staged

#: Near copies have this Jaccard similarity or more, on shingles of this many words.
SHINGLE, SIMILARITY = 5, 0.8


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, of hosts that pass."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return near_copies.keep_first(docs, SHINGLE, SIMILARITY)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated passages."""
    small_batches(spark)
    return suffix_dedup.remove(docs, suffix_dedup.PASSAGE, suffix_dedup.PASSAGE_GRAM, keep="first", unit="words")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    small_batches(spark)
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in training sequences."""
    small_batches(spark)
    return packing.pack(docs).drop("source", "cluster")


STAGES = [
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", passages),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: SQL has neither the fingerprints nor the tagger nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
