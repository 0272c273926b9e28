"""Markdown documents below a root, and a table of them that changes by snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.functions import columns as C
from runlens.storage import durable


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, service, category, content, n_chars) of every *.md below root."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")
    return files.select(path.alias("path"), C.parent_name(path).alias("service"), C.stem(path).alias("category"), F.col("value").alias("content"), F.length("value").cast("bigint").alias("n_chars"))


def listed(docs: DataFrame, order: str = "path", name: str = "id") -> DataFrame:
    """docs with a position, from 0, in the order of a column.

    Positions come from the counts of sorted ranges, so that no task sees more than its range.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written first: the numbers of the ranges must be the same wherever they are read
    ranged = durable(docs.repartitionByRange(n, order).withColumn("__runlens_part", F.spark_partition_id()), "listed")
    at = Window.partitionBy("__runlens_part").orderBy(order)
    local = ranged.withColumn("__runlens_at", F.row_number().over(at))
    sizes = ranged.groupBy("__runlens_part").agg(F.count(F.lit(1)).alias("__runlens_n"))
    before = sizes.select("__runlens_part", F.coalesce(F.sum("__runlens_n").over(Window.orderBy("__runlens_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__runlens_before"))
    return local.join(F.broadcast(before), "__runlens_part").withColumn(name, (F.col("__runlens_at") + F.col("__runlens_before") - 1).cast("bigint")).drop("__runlens_part", "__runlens_at", "__runlens_before")


def content_of(docs: DataFrame, path: str, root: str) -> DataFrame:
    """One document's content; paths that leave the root match nothing."""
    inside = not any(part == ".." for part in path.replace("\\", "/").split("/")) and path.startswith(root.rstrip("/") + "/")
    return docs.filter((F.col("path") == path) & F.lit(inside)).select("path", "content", F.length("content").cast("bigint").alias("size"))
