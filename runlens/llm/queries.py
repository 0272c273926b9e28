"""The opN_ queries and their SQL: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runlens.llm import alignment, bpe, centroids, exact_dedup, fingerprint, html_extract, language_id, licenses, mixing, near_dedup, quality, substrings, warc
from runlens.llm.common import table
from runlens.storage import spread


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_paths(spread(table(spark, sf_dir, "documents"))))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(spread(table(spark, sf_dir, "documents")), words=3, percent=85)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_table(spread(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(spread(table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_table(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(spread(table(spark, sf_dir, "documents")))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_table(spread(table(spark, sf_dir, "documents")))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_table(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_exact_dedup, op2_html_extraction, op3_license_scan, op4_near_dedup, op5_language_id,
        op6_mixing, op7_warc, op8_byte_bpe, op9_quality, op10_fingerprints,
        op11_token_alignment, op12_substring_dedup, op13_centroid_clustering,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op4_near_dedup": near_dedup.ORACLE, "op6_mixing": mixing.ORACLE, "op7_warc": warc.ORACLE, "op12_substring_dedup": substrings.ORACLE, "op13_centroid_clustering": centroids.ORACLE}
