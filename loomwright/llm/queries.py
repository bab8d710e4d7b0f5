"""The corpus operators as queries over the test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, exact_dedup, html, mixing, near_dedup, neighbours, oracle, packing, phrases, quality, quality_model, secrets, toxicity, urls
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's secrets: the base patterns' counts and digest, and all spans."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts, and whether the rules keep it."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(F.col("_row.doc_id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host, path, rule and verdict."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity, from labels of three quarters of the ids."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's component of near-duplicates at 85 %."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality, from labels of three quarters of the ids."""
    return quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's main text."""
    return html.extract(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece's length, bucket, batch and slot."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's size, its source's target and the words that the mix takes."""
    return mixing.plan(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of texts that are equal but for white space, and whether it stays."""
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's centroid after ten rounds in integers."""
    return clustering.clustered(table(spark, sf_dir, "embeddings"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best collocations of two to five words."""
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_quality_rules, op3_url_filter, op4_toxicity, op5_minhash_near_dedup, op6_quality_classifier, op7_html_extraction, op8_packing, op9_nearest_neighbours, op10_source_mixing, op11_exact_dedup, op12_centroid_clustering, op13_phrase_mining)}
#: The others rest on lexing, learnt models, hashes, graphs or dynamic programming: they are tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": oracle.QUALITY,
    "op3_url_filter": oracle.URLS,
    "op5_minhash_near_dedup": oracle.NEAR_DUPLICATES,
    "op8_packing": oracle.PACKING,
    "op9_nearest_neighbours": oracle.NEIGHBOURS,
    "op10_source_mixing": oracle.MIXING,
    "op11_exact_dedup": oracle.EXACT,
    "op12_centroid_clustering": oracle.CLUSTERED,
    "op13_phrase_mining": oracle.PHRASES,
}
