"""A corpus pipeline: language, exact copies, near copies, mix, tokens. Each stage reads what the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from runlens.llm.common import drop, scratch, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told stay."""
    return language_id.known_language(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the least doc_id stays."""
    return near_dedup.without_near_copies(docs, words=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per copy of a document: doc_id, source, n_tokens and the digests of ids and decoded bytes."""
    return bpe.token_digests(docs, carry=("source",)).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing", mix_stage),
    ("byte-level BPE", token_stage),
]

#: The language model can't be expressed in SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage has written on its way goes with it, its input when it has been read
            done = keep(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
