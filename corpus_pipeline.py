"""Corpus pipeline: rules, near-duplicates, secrets, mixing and packing, each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwright.llm import mixing, near_dedup, packing, quality, secrets
from loomwright.llm.common import Workspace, table

#: Documents are near-duplicates in the pipeline from this similarity on; op5's query has its own.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that no rule rejects; null and empty texts fail the base and go. Every other column comes back as it was."""
    return quality.keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least doc_id, with all its rows. Rows without words or without doc_id stay."""
    return near_dedup.keep_one_of_each(docs, percent=NEAR_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each secret in a text replaced by a mark and n_chars following; null and empty texts stay as they are."""
    return secrets.redact_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its words, to the nearest whole copy; rows without words take none. Null is a source of its own."""
    return mixing.mix(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a text: doc_id, piece, n_tokens, bucket, batch, slot; a text without words is one piece without a bucket."""
    return packing.pack(docs)


#: (name, function): each takes what the one before kept, and all but the last return the columns of documents.
STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", minhash_near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mixing),
    ("packing", length_packing),
]
#: Near-duplicates, lexing, hashes and dynamic programming aren't expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each written to the shared folder and read again."""
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), str(k))
        if k:
            work.drop(str(k - 1))
    return docs
