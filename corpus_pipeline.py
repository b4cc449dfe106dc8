"""The corpus pipeline: ``documents`` through quality rules, deduplication,
masking of personal data and packing, each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm import pii
from limnos.llm.common import documents, land
from limnos.llm.exact_dedup import drop_copies
from limnos.llm.near_dedup import drop_near_copies
from limnos.llm.packing import pack
from limnos.llm.quality import drop_low_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or a perplexity band reject."""
    return drop_low_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal but for white space."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of near-duplicates: shingles of five words, Jaccard
    similarity 0.8 or more."""
    return drop_near_copies(docs, percent=80, shingle_words=5)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and disclosing terms masked; n_chars follows."""
    masked = pii.sanitise(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) \
        if "n_chars" in docs.columns else masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bucket, batch and slot for each document."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mask_pii", mask_pii),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = land(docs, f"pipeline-{name}")
    return docs


#: Perplexity, sketches and dynamic programming are beyond SQL: the tests hold
#: the stages against brute force.
ORACLE_SQL = None
