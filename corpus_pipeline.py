"""A corpus pipeline of five stages: toxicity, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows to the shared scratch
folder and reads them again, so a lost executor costs no more than a stage. All but the last return the columns of
``documents``. A worker lives through all stages, so they ask for small Arrow batches.

Every stage takes null ids and texts (an empty text), repeated rows (each a document, until the second stage leaves one
of equal texts), texts of any length, further columns of any name, and an empty table, which stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm import decontaminate, jaccard_join, packing, pii, toxicity
from evenkeel.llm.common import small_batches, stored, table
from evenkeel.llm.queries import vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id."""
    small_batches(spark)
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows."""
    small_batches(spark)
    return pii.masked(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, vocabulary(), special=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# Learned scores and spans, block-wise packing and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        rows = stored(stage(spark, rows, sf_dir))
    return rows
