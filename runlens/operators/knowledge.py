"""The knowledge base: official records, learned corrections, and a search that prefers the latter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import columns as C
from runlens.functions.vector import nearest

#: A correction counts below this squared distance; sources and labels of answers.
NEAR = 0.4
LEARNED, OFFICIAL, UNKNOWN = "LEARNED", "OFFICIAL", "UNKNOWN"
FEEDBACK_SCHEMA = "id string, text string, correct_doc_path string, added_by string, ts string"


def two_tier(requests: DataFrame, learned: DataFrame, official: DataFrame, near: float = NEAR, but_itself: bool = False) -> DataFrame:
    """(qid, source, id, distance, confidence) for every request (qid, vector).

    The nearest correction wins below `near`; otherwise the nearest official record; without
    one the answer is unknown. The official tier is searched only for what the first leaves.
    """
    first = nearest(requests, learned).filter(F.col("value") < near).select("qid", F.col("id").alias("_l"), F.col("value").alias("_ld"))
    left = requests.join(first.select("qid"), "qid", "left_anti")
    second = nearest(left, official, but_itself=but_itself).select("qid", F.col("id").alias("_o"), F.col("value").alias("_od"))
    both = requests.select("qid").join(first, "qid", "left").join(second, "qid", "left")
    source = F.when(F.col("_l").isNotNull(), LEARNED).when(F.col("_o").isNotNull(), OFFICIAL).otherwise(UNKNOWN)
    label = F.when(source == LEARNED, "High").when(source == OFFICIAL, "Normal").otherwise("")
    return both.select(
        "qid", source.alias("source"), F.coalesce("_l", "_o").alias("id"), F.coalesce("_ld", "_od").alias("distance"),
        C.parsed_confidence(F.lit(None), label).alias("confidence"),
    )


def corrections(rows: DataFrame) -> DataFrame:
    """Valid corrections (text, correct_doc_path, ts) with ids; both fields are required."""
    ok = rows.filter((C.or_empty(F.col("text")) != "") & (C.or_empty(F.col("correct_doc_path")) != ""))
    return ok.select(C.correction_id(F.col("text"), F.col("correct_doc_path"), F.col("ts").cast("string")).alias("id"), "text", "correct_doc_path", F.lit("user").alias("added_by"), F.col("ts").cast("string").alias("ts"))


def counted(official: DataFrame, learned: DataFrame, methods: tuple[str, ...], every: tuple[str, ...]) -> DataFrame:
    """One row: healthy, model_status, vector_db_status, vector_db_records, learned_corrections; methods: those of `every` that can answer."""
    ready = lambda m: "Ready" if m in methods else "Not loaded"  # noqa: E731  fixed values: the wording of a status
    vector, semantic, forest = every
    records = official.agg(F.count(F.lit(1)).alias("vector_db_records"))
    return records.crossJoin(learned.agg(F.count(F.lit(1)).alias("learned_corrections"))).select(  # one row each
        F.lit(bool(methods)).alias("healthy"), F.lit(f"RF: {ready(forest)}, Semantic: {ready(semantic)}").alias("model_status"),
        F.lit(ready(vector)).alias("vector_db_status"), "vector_db_records", "learned_corrections",
    )


def latest(feedback: DataFrame) -> DataFrame:
    """The last correction of each text."""
    return feedback.groupBy("text").agg(F.max(F.struct("ts", "id", "correct_doc_path")).alias("m")).select("text", F.col("m.id").alias("id"), F.col("m.correct_doc_path").alias("correct_doc_path"))
