"""From raw documents to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept,
and is written as Parquet before the next one reads it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlens.llm.common import keep_rows, read
from pairlens.llm.exact_dedup import exact_duplicates
from pairlens.llm.near_copies import copy_representatives
from pairlens.llm.packing import pack_documents
from pairlens.llm.quality_rules import keep_quality
from pairlens.llm.secret_scan import redact, scan_new
from pairlens.operators.staging import scratch, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned decision list."""
    return keep_quality(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return keep_rows(docs, exact_duplicates(docs).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return keep_rows(docs, copy_representatives(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced by a mark."""
    ledger = scratch(spark)
    scan_new(docs, ledger)
    return redact(docs, ledger)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", packing),
]

#: The learned rules and fingerprints are not SQL; tests hold the pipeline against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs
