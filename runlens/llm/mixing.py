"""Mixing sources to target weights (native DataFrame operations only).

Tokens are summed per source; targets share a budget by weight, stop at a cap and hand the
excess on (water filling, in closed form by a running sum over the sources); each document
is emitted floor(rate) times plus one copy more if its hashed coin falls under the fraction.

What moves: one row per source and task (map-side sums), then one row per source. The
per-source table comes back to the documents by a join in which that side has one row per
key; a hot source is split by the adaptive skew join or read against a broadcast that
Spark sizes itself.

Defined results: a null text has size 0; a null source is a source of its own, ordered
last; rows that repeat a doc_id share its coin, so reruns agree; a null doc_id has the coin
of the empty string; sources of size 0 have target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import durable

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2.0
SEED = "mix"


def sized(docs: DataFrame) -> DataFrame:
    """docs with size: the words of the text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, rate) from (source, size) rows.

    With caps c and weights w, the level L solves sum(min(c, w * L)) = budget * total. In
    ascending c / w the first k sources stand at their caps, and L follows from the rest;
    resharing the excess again and again ends at the same targets.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.withColumn("_w", F.element_at(pick, F.pmod(F.row_number().over(at) - 1, F.lit(len(weights))).cast("int") + 1))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = ranked.select(
        "*",
        ((F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)).alias("_level"),
    )
    # the level of the first source that stays under its cap is the level of all that follow it
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", F.col("source").isNull().alias("_last"), "source", "_level"))).over(everything)["_level"]
    target = F.least(F.col("_cap"), F.coalesce(F.col("_w") * level, F.col("_cap")))
    return steps.withColumn("target", target).select(
        "source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate")
    )


def copies_of(rate: str = "rate", id_col: str = "doc_id"):
    """floor(rate) copies and one more with the fraction's probability: 32 bits of md5 as the coin."""
    coin = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    whole = F.floor(F.col(rate))
    return (whole + F.when(coin < F.col(rate) - whole, F.lit(1)).otherwise(F.lit(0))).cast("long")


def planned(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, and the whole row of docs as the struct _doc."""
    each = sized(docs.select("doc_id", "source", "text", F.struct("*").alias("_doc"))).drop("text")
    # written first: its true size then decides, before the documents move, whether it is broadcast
    targets = durable(source_targets(each.select("source", "size"), weights, budget, cap).withColumnRenamed("source", "_source"), "mix-targets")
    return each.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("copies", copies_of())


def mix_table(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken."""
    return planned(docs.select("doc_id", "source", "text")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as its plan says, with the columns of docs."""
    return planned(docs).filter("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")


ORACLE = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS wt,
      source_size * 2.0::DOUBLE AS cap FROM per),
s AS (SELECT *, cap / wt AS ratio, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / wt, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(wt) OVER (ORDER BY cap / wt, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
l AS (SELECT lvl FROM s WHERE lvl <= ratio ORDER BY ratio, encode(source) NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce(wt * (SELECT lvl FROM l), cap)) AS target FROM s),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM c
"""
