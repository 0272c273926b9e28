"""Requests and corrections as streams: every batch is answered by what has been taught until it starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens.triage import Triage

REQUEST = "qid bigint, service string, category string, snippet string, method string"
CORRECTION = "text string, correct_doc_path string, ts string"
ANSWER = "qid bigint, method string, status bigint, error string, doc_path string, confidence double, source string, is_fallback boolean, root_cause string, warning string"


def _incoming(spark: SparkSession, source: str, schema: str, fmt: str) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(source)


def answer_stream(triage: Triage, source: str, sink: str, checkpoint: str, fmt: str = "json"):
    """Answer the requests that lie in source; ends when all are answered.

    A batch reads records, documents and corrections anew, and its answers replace those of its
    number, so one that runs again after a failure answers nobody twice.
    """

    def answer(batch: DataFrame, number: int) -> None:
        triage.classify(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return _incoming(triage.spark, source, REQUEST, fmt).writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers(spark: SparkSession, sink: str) -> DataFrame:
    """All answers so far, with the number of their batch."""
    return spark.read.schema(f"{ANSWER}, batch bigint").option("basePath", sink).parquet(sink)


def teach_stream(triage: Triage, source: str, checkpoint: str, name: str = "stream", fmt: str = "json"):
    """Teach the corrections that lie in source; each batch is one part of the learned table, put there as a whole.

    name: of the stream, as two streams number their batches alike.
    """

    def teach(batch: DataFrame, number: int) -> None:
        triage.teach(batch, part=f"{name}-{number}")

    return _incoming(triage.spark, source, CORRECTION, fmt).writeStream.foreachBatch(teach).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
