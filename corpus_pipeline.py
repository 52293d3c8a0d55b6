"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept, written as Parquet and read again.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import decontam, langid, ngramjoin, packing, secrets
from cohortloom.llm.common import cut, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear stay."""
    return langid.keep_identified(docs, langid.fit(docs))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays, that with the least id; ``ngramjoin.keep_one`` states the other cases."""
    return ngramjoin.keep_one(docs, width=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"), width=10)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", join_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", scan_secrets),
    ("packing", pack),
]

#: Tokenizing and compression are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
