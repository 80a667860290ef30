"""Corpus pipeline: quality rules, near-dedup, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next one's docs. All but the last return the columns of
`docs`; the last returns one row per packed piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.session import cut
from plumbline.llm import decontaminate, near_dedup, packing, pii, quality_rules
from plumbline.llm.common import read_table

#: The verdicts need 64-bit hashes and tokenizers that SQL lacks; the tests hold the stages against brute force.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.quality_rules(docs, trusted).where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of each component that names it; links as in op5. Five words and 0.8 are the stage's bounds."""
    gone = near_dedup.near_duplicates(docs, size=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Test passages are cut out; documents that consist of them by more than half go."""
    clean = decontaminate.remove_items(docs, read_table(spark, sf_dir, "benchmark")).select(*docs.columns)
    return _recounted(clean)


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; every document stays."""
    return _recounted(pii.redact(docs)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", rules), ("near duplicates", near_copies), ("decontamination", without_benchmark),
    ("personal data", redacted), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
