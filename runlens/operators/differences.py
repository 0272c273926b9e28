"""The difference of two versions of a table, repeated rows included, and its application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSERTED, DELETED, CHANGED = "inserted", "deleted", "changed"


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(columns, change, kind): how many rows more (or, negative, less) of each row new has.

    Rows of one key that both went and came are changed, others inserted or deleted. Equal rows meet
    in one aggregation and go there; the rest, as large as the difference, finds its kind by key.
    Nulls are equal to nulls, in keys too. Columns are taken by name; maps can't be compared.
    """
    names = old.columns
    rows = old.withColumn("change", F.lit(-1).cast("bigint")).unionByName(new.select(*names).withColumn("change", F.lit(1).cast("bigint")))
    moved = rows.groupBy(*names).agg(F.sum("change").alias("change")).filter("change != 0")
    both = moved.groupBy(F.col(key).alias("_key")).agg((F.max(F.col("change") > 0) & F.max(F.col("change") < 0)).alias("_both")).filter("_both")
    kind = F.when(F.col("_both"), CHANGED).when(F.col("change") > 0, INSERTED).otherwise(DELETED)
    return moved.join(both, moved[key].eqNullSafe(both["_key"]), "left").select(*names, "change", kind.alias("kind"))


def applied(old: DataFrame, changes: DataFrame) -> DataFrame:
    """old after the changes of difference(); a row that isn't there can't go: what is missing counts as none."""
    names = old.columns
    rows = old.withColumn("change", F.lit(1).cast("bigint")).unionByName(changes.select(*names, "change"))
    left = rows.groupBy(*names).agg(F.sum("change").alias("change")).filter("change > 0")
    return left.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("change")))).select(*names)
