"""Totals at every level of some dimensions, and sketches that stand for many rows: both are kept and added to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of the sketches: 2**HLL registers (a standard error of 1.04 / 2**(HLL/2) = 0.8 %), and KLL's accuracy (ranks within about 1 %).
HLL, KLL = 14, 400


def levels(rows: DataFrame, dims: list[str], sums: list[str]) -> DataFrame:
    """(dims, level, n, sums) of all groupings of dims in one pass: a null dimension is rolled up where its bit of level is set.

    Tasks add up before the only shuffle, which gets a row for each group and task at most.
    """
    return rows.cube(*dims).agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in sums])


def added(kept: DataFrame, more: DataFrame, dims: list[str], sums: list[str]) -> DataFrame:
    """Totals of levels() over the rows of both; kept ones needn't be read again from their rows."""
    return kept.unionByName(more).groupBy(*dims, "level").agg(*[F.sum(c).alias(c) for c in ("n", *sums)])


def sketched(rows: DataFrame, by: list[str], who: str, value: str) -> DataFrame:
    """(by, n, who, value): counts and two sketches of a few kilobytes a group, of distinct `who` and of the distribution of `value`."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(who, HLL).alias("who"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL).alias("value"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of larger groups, from those of their parts."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("who").alias("who"), F.kll_merge_agg_double("value", KLL).alias("value"))


def told(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The sketches' answers: distinct `who`, and the named quantiles of `value`."""
    others = [c for c in sketches.columns if c not in ("who", "value")]
    return sketches.select(*others, F.hll_sketch_estimate("who").alias("who"), *[F.kll_sketch_get_quantile_double("value", F.lit(q)).alias(n) for n, q in quantiles.items()])


def exact(rows: DataFrame, by: list[str], who: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """What told() estimates, from the rows themselves."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(who).alias("who"), *[F.percentile(F.col(value).cast("double"), q).alias(n) for n, q in quantiles.items()])
