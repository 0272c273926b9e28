"""Joins and frames in time: the latest row before, the intervals around, and what lies in a trailing span.

All of them deal rows out by key and block of time, so that a key with a third of all rows is many
groups. What a block needs from before it comes as rows of its own: the last row of earlier blocks
(as_of), or copies of the rows that its frames reach back to (trailing). None joins rows with rows
by time alone, so no plan has a cross or nested loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of nodes of time: with cells of a second the last one holds 34,000 years.
LEVELS = 40


def micros(time: str | Column) -> Column:
    """Microseconds of a timestamp, with or without a zone; UTC for the latter."""
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], block: int = 3600, inclusive: bool = True) -> DataFrame:
    """left with the values of the latest row of right that has its key and is no later (or, not inclusive, earlier).

    Of several such rows of one time the greatest by values, in their order, counts. Rows without
    such a row, a key or a time have nulls. block: seconds of time that are one group of a key.
    """
    width = block * 1_000_000
    have = [F.col(c).isNotNull() for c in by] + [F.col(time).isNotNull()]
    whole = have[0]
    for h in have[1:]:
        whole = whole & h
    at, in_block = micros(time), F.floor(micros(time) / width)
    # a row of right is one value that grows with time, so the latest so far is a maximum
    found = right.filter(whole).select(*by, in_block.alias("_block"), at.alias("_at"), F.struct(at.alias("_t"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)]).alias("_r"))
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l")
    asked = left.filter(whole).select(*by, in_block.alias("_block"), at.alias("_at"), row)
    # the last row of each block, and for each block that is asked about the last one before it
    last = found.groupBy(*by, "_block").agg(F.max("_r").alias("_r"), F.lit(False).alias("_asked"))
    blocks = last.unionByName(asked.select(*by, "_block").distinct().withColumns({"_r": F.lit(None).cast(last.schema["_r"].dataType), "_asked": F.lit(True)}))
    blocks = blocks.groupBy(*by, "_block").agg(F.max("_r").alias("_r"), F.max("_asked").alias("_asked"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    carried = blocks.withColumn("_r", F.max("_r").over(earlier)).filter("_asked AND _r IS NOT NULL").select(*by, "_block", F.lit(None).cast("bigint").alias("_at"), "_r")
    none = {"_l": F.lit(None).cast(asked.schema["_l"].dataType)}
    side = lambda df, n: df.withColumn("_side", F.lit(n))
    rows = side(found.unionByName(carried).withColumns(none), 1 if inclusive else 3).unionByName(side(asked.withColumn("_r", F.lit(None).cast(found.schema["_r"].dataType)), 2))
    so_far = Window.partitionBy(*by, "_block").orderBy(F.asc_nulls_first("_at"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("_m", F.max("_r").over(so_far)).filter("_side = 2")
    out = met.select("_l.*", *[F.col(f"_m._v{i}").alias(v) for i, v in enumerate(values)])
    rest = left.filter(~F.coalesce(whole, F.lit(False)))
    return out.unionByName(rest.select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]))


def _nodes(cells: DataFrame, columns: list[str]) -> DataFrame:
    """columns, _level, _node: the cells from _a up to before _b in the fewest nodes, at most two a level."""
    level = F.sequence(F.lit(0), F.lit(LEVELS - 1))

    def nodes(k: Column) -> Column:
        size = F.pow(F.lit(2), k).cast("bigint")
        a, b = F.floor((F.col("_a") + size - 1) / size), F.floor(F.col("_b") / size)
        left, right = F.when((a < b) & (F.pmod(a, F.lit(2)) == 1), F.struct(k.alias("_level"), a.alias("_node"))), F.when((a < b) & (F.pmod(b, F.lit(2)) == 1), F.struct(k.alias("_level"), (b - 1).alias("_node")))
        return F.array(left, right)

    cut = cells.withColumn("_n", F.explode(F.filter(F.flatten(F.transform(level, nodes)), lambda n: n.isNotNull())))
    return cut.select(*columns, "_n._level", "_n._node")


def _in_nodes(points: DataFrame, time: str, used: list[int], width: int) -> DataFrame:
    """points once for each of the used levels, with their node there."""
    own = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in used]) if used else F.array().cast("array<int>")))
    return own.withColumn("_node", F.floor(F.floor(micros(time) / width) / F.pow(F.lit(2), F.col("_level")).cast("bigint")))


def holding(points: DataFrame, intervals: DataFrame, by: list[str], time: str, start: str, end: str, cell: int = 60) -> DataFrame:
    """points joined with the intervals of their key that hold them: start <= time < end.

    An interval is cut into the fewest nodes of a binary tree over cells of time, at most two a
    level; a point lies in one node a level, so each pair meets in exactly one node, and a long
    interval is few rows. Levels that no interval uses are not looked into. Columns of both must
    differ but for the keys. Rows with null keys or times, and empty intervals, meet nothing.
    """
    width = cell * 1_000_000
    some = intervals.filter(F.col(start) < F.col(end))
    first, past = F.floor(micros(start) / width), F.floor((micros(end) - 1) / width) + 1
    cut = _nodes(some.withColumns({"_a": first, "_b": past}), intervals.columns)
    used = sorted(r[0] for r in cut.select("_level").distinct().collect())  # LEVELS at most
    own = _in_nodes(points, time, used, width)
    met = own.join(cut, [*by, "_level", "_node"])
    return met.filter((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_level", "_node")


def holding_totals(points: DataFrame, intervals: DataFrame, by: list[str], time: str, start: str, end: str, name: str, totals: dict[str, tuple[Column, Callable]], cell: int = 60) -> DataFrame:
    """(name, totals) of the points of its key that each interval holds, start <= time < end; intervals without points are left out.

    totals: an aggregate of points, and the one that puts its parts together. The whole cells of
    an interval are met as nodes that were totalled once; single points are joined only with the
    parts of cells at both ends.
    """
    width = cell * 1_000_000
    some = intervals.select(name, *by, F.col(start).cast("timestamp").alias("_s"), F.col(end).cast("timestamp").alias("_e")).filter("_s < _e")
    a, b = F.floor((micros("_s") + width - 1) / width), F.floor(micros("_e") / width)
    cut_, from_ = F.when(a <= b, F.timestamp_micros(a * width)).otherwise(F.col("_e")), F.when(a <= b, F.timestamp_micros(b * width)).otherwise(F.col("_e"))
    ends = some.select(name, *by, F.explode(F.array(F.struct(F.col("_s").alias("_s"), cut_.alias("_e")), F.struct(from_.alias("_s"), F.col("_e").alias("_e")))).alias("_p")).select(name, *by, "_p.*")
    told = holding(points, ends, by, time, "_s", "_e", cell).groupBy(name).agg(*[c.alias(t) for t, (c, _) in totals.items()])
    cut = _nodes(some.withColumns({"_a": a, "_b": b}).filter("_a < _b"), [name, *by])
    used = sorted(r[0] for r in cut.select("_level").distinct().collect())  # LEVELS at most
    nodes = _in_nodes(points, time, used, width).groupBy(*by, "_level", "_node").agg(*[c.alias(t) for t, (c, _) in totals.items()])
    whole = cut.join(nodes, [*by, "_level", "_node"]).select(name, *totals)
    return told.unionByName(whole).groupBy(name).agg(*[put(t).alias(t) for t, (_, put) in totals.items()])


def trailing(rows: DataFrame, by: list[str], time: str, width: int, totals: dict[str, Column], block: int = 3600, sums: dict[str, Column] | None = None) -> DataFrame:
    """rows with totals (aggregates) and sums (of whole numbers) over those of their key from `width` seconds before their time up to it.

    Blocks of time are dealt out with copies of the rows that their frames reach back to, one copy a
    row at most: a block is never shorter than a frame. Rows without a time have nulls. A total
    is formed anew for every row from all of its frame; a sum is that of all rows so far less that
    of the rows before the frame, each of which a block adds up once, however dense its frames.
    """
    size, reach = max(block, width) * 1_000_000, width * 1_000_000
    at = micros(time)
    own = F.floor(at / size)
    timed = rows.filter(F.col(time).isNotNull()).withColumn("_at", at)
    placed = timed.withColumns({"_block": own, "_own": F.lit(True)})
    copies = timed.filter((own + 1) * size - reach <= F.col("_at")).withColumns({"_block": own + 1, "_own": F.lit(False)})
    frame = Window.partitionBy(*by, "_block").orderBy("_at").rangeBetween(-reach, 0)
    in_order = Window.partitionBy(*by, "_block").orderBy("_at")
    so_far, before = in_order.rangeBetween(Window.unboundedPreceding, 0), in_order.rangeBetween(Window.unboundedPreceding, -reach - 1)
    within = lambda c: c.over(so_far) - F.coalesce(c.over(before), F.lit(0))
    found = {n: c.over(frame) for n, c in totals.items()} | {n: F.when(within(F.count(c)) > 0, within(F.sum(c))) for n, c in (sums or {}).items()}
    told = placed.unionByName(copies).withColumns(found).filter("_own").drop("_at", "_block", "_own")
    rest = rows.filter(F.col(time).isNull())
    return told.unionByName(rest.withColumns({n: F.lit(None).cast(told.schema[n].dataType) for n in found}))
