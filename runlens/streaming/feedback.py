"""Feedback as a stream: files of corrections arrive, each batch is appended and seen by the next search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.knowledge import FEEDBACK_SCHEMA, corrections


def feedback_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str = "text string, correct_doc_path string, ts string", fmt: str = "json"):
    """Start taking what lies in source to sink; ends when all that was there is in. Reruns add only new files."""
    rows = corrections(spark.readStream.format(fmt).schema(schema).load(source))
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def stored(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.schema(FEEDBACK_SCHEMA).parquet(sink)


def windowed_counts(events: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n): late rows up to `delay` count; works on a stream and on a table."""
    typed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if typed.isStreaming:
        typed = typed.withWatermark("ts", delay)
    return typed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def keep_counts(counts: DataFrame, sink: str, checkpoint: str):
    """Start writing the counts so far to files, a folder a batch; a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/{number:012d}")

    return counts.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_counts(spark: SparkSession, sink: str) -> DataFrame:
    """The counts of the last batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
    last = max(s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path))
    return spark.read.schema("start timestamp, event_type string, n bigint").parquet(f"{sink}/{last}")
