"""Error records from lines: a tolerant grammar, a strict one, and what either turns away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.functions.columns import stripped
from runlens.storage import durable

FIELDS = ("timestamp", "service", "category", "snippet", "cause")
#: Fixed value: header names of a records file.
SCHEMA = "Timestamp string, Service string, Error_Category string, Raw_Input_Snippet string, Root_Cause string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of each file, from 1, in file order; an end of line at a file's end starts no further line.

    Files are read in splits: a line's number is its place in its split behind the lines of the
    file's earlier splits, so no task sees more than one split.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    read = read.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"))
    # written first: where the splits begin may change with the number of cores
    lines = durable(read, "lines")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = lines.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n")).select("_file", "_split", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_file", "_split").orderBy("_row"))
    return lines.withColumn("_at", place).join(splits, ["_file", "_split"]).select((F.col("_before") + F.col("_at")).cast("bigint").alias("line_no"), F.col("value").alias("line"))


def parsed(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """lines with the five fields and `reason`.

    The first three commas end timestamp, service and category; the last comma of the rest
    separates snippet and cause. reason: blank, malformed (under four parts), missing_cause, or null.
    """
    line = F.col(line_col)
    parts = F.split(line, ",", 4)
    rest = F.try_element_at(parts, F.lit(4))
    reason = (
        F.when(stripped(line) == "", "blank").when(F.size(parts) < 4, "malformed").when(~rest.contains(","), "missing_cause")
    )
    return lines.select(
        "*",
        parts[0].alias("timestamp"), F.try_element_at(parts, F.lit(2)).alias("service"), F.try_element_at(parts, F.lit(3)).alias("category"),
        stripped(F.regexp_extract(rest, r"(?s)^(.*),([^,]*)$", 1)).alias("snippet"), stripped(F.regexp_extract(rest, r"(?s)^(.*),([^,]*)$", 2)).alias("cause"),
        reason.alias("reason"),
    )


def lenient(spark: SparkSession, path: str, strip_all: bool = False) -> DataFrame:
    """The records of a file with a header line; strip_all is the knowledge base's way."""
    rows = parsed(numbered_lines(spark, path).filter("line_no > 1")).filter("reason IS NULL").drop("reason", "line")
    if strip_all:
        rows = rows.withColumns({c: stripped(F.col(c)) for c in ("timestamp", "service", "category")})
    return rows


def rejects(spark: SparkSession, path: str) -> DataFrame:
    return parsed(numbered_lines(spark, path).filter("line_no > 1")).filter("reason IS NOT NULL").select("line_no", "reason", "line")


def strict(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Quoted CSV; tokens beyond the five columns are dropped, empty ones stay empty."""
    rows = spark.read.schema(SCHEMA).option("header", header).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in zip(("Timestamp", "Service", "Error_Category", "Raw_Input_Snippet", "Root_Cause"), FIELDS, strict=True)])


def batch_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)
