"""Documents to packed sequences: the training-data operators in order.

Each stage works on all rows that the one before kept; run() writes each stage's rows as
Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import language_id, secrets, simhash, substrings
from strandweave.llm.queries import packed
from strandweave.plans.workspace import Workspace

ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the corpus teaches go."""
    return language_id.drop_unidentified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays: five-word shingles, similarity 0.8."""
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated sentence runs go, and documents of which nothing is left."""
    kept = substrings.remove_repeats(docs)
    return kept.where("text IS NULL OR length(trim(text)) > 0")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the documents stay."""
    return secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents, placed in sequences."""
    return packed(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", identify),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", repeats),
    ("secret scan", secret_scan),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
