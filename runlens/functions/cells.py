"""Approximate nearest neighbours: every row lies in the cell of its nearest centre, a query looks into a few cells.

How many, follows from the data: fit() takes the least number that finds TARGET of the neighbours within its
sample, whose neighbours lie further away, and so in more cells, than those among all rows. Vectors without
clusters need many. The exact way is vector.nearest(); recall() tells how much of it a search finds.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.vector import QUERY_BLOCK

#: Rows that the centres are fitted on: those of the least hashes of their ids, all if there are no more.
SAMPLE = 20_000
CENTRES = 256
ROUNDS = 12
#: Share of the 5 nearest rows of PROBED rows of the sample that must lie in the cells looked into.
TARGET = 0.95
PROBED = 400


class Cells(NamedTuple):
    """Centres, one a row, and the number of cells that a query looks into."""

    centres: np.ndarray
    probes: int


def fit(corpus: DataFrame, centres: int = CENTRES, sample: int = SAMPLE, rounds: int = ROUNDS, target: float = TARGET) -> Cells:
    """The cells for corpus (id, vector), by k-means on the sample; without centres if no row has a vector.

    Starts from the first rows of the sample that differ; a centre that loses its rows stays where it is.
    The driver holds the sample, whose size is bounded by the parameter, and nothing else.
    """
    rows = corpus.filter("vector IS NOT NULL").select(F.xxhash64("id").alias("h"), F.col("vector").cast("array<double>").alias("vector"))
    drawn = rows.orderBy("h", "vector").limit(sample).collect()
    if not drawn:
        return Cells(np.zeros((0, 0)), 0)
    x = np.array([r["vector"] for r in drawn], dtype=np.float64)
    _, first = np.unique(x, axis=0, return_index=True)
    c = x[np.sort(first)[:centres]].copy()
    for _ in range(rounds):
        own = _cells_of(x, c, 1)[:, 0]
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return Cells(c, _probes(x, c, target))


def _probes(x: np.ndarray, centres: np.ndarray, target: float) -> int:
    """The least number of cells that hold `target` of the 5 nearest rows of the last PROBED rows, from which no centre starts if there are enough."""
    q = x[-PROBED:]
    far = np.einsum("ij,ij->i", x, x) - 2 * (q @ x.T)
    far[np.arange(len(q)), np.arange(len(x) - len(q), len(x))] = np.inf
    near = np.argsort(far, axis=1, kind="stable")[:, : min(5, len(x) - 1)]
    place = np.argsort(_cells_of(q, centres, len(centres)), axis=1)  # of each cell in a query's order
    ranks = np.sort(np.take_along_axis(place, _cells_of(x, centres, 1)[:, 0][near], axis=1).ravel())
    return int(ranks[int(np.ceil(target * len(ranks))) - 1]) + 1 if len(ranks) else len(centres)


def _cells_of(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, the nearest first."""
    near = np.einsum("ij,ij->i", centres, centres) - 2 * (x @ centres.T)
    return np.argsort(near, axis=1, kind="stable")[:, :n]


def placed(corpus: DataFrame, cells: Cells) -> DataFrame:
    """The index: (cell, id, vector) of every row of corpus (id, vector) that has a vector, to be written by the caller.

    Rows stay in the task that reads them and are sorted by cell there, so that a cell's rows lie together.
    """
    held = corpus.sparkSession.sparkContext.broadcast(cells.centres)  # CENTRES rows at most

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = [_cells_of(x[at : at + 4096], held.value, 1)[:, 0] for at in range(0, len(x), 4096)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).astype(np.int32)), *batch.columns], ["cell", "id", "vector"])

    rows = corpus.filter("vector IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "cell int, id bigint, vector array<double>").sortWithinPartitions("cell")


def search(queries: DataFrame, index: DataFrame, cells: Cells, k: int = 1, probes: int | None = None, but_itself: bool = False, digits: int = 6) -> DataFrame:
    """(qid, id, value, rank): of the rows in a query's `probes` (else those of fit()) nearest cells, the k of the least squared distance.

    queries: (qid, vector); index: what placed() gave. Ties go to the least id. With as many probes as
    there are centres the result is the exact one. Queries are broadcast in blocks of at most
    about QUERY_BLOCK; no row of the index moves, however full its cell is, and a task sends
    at most k rows a query.
    """
    spark = queries.sparkSession
    queries = queries.filter("vector IS NOT NULL")
    passes = -(-queries.count() // QUERY_BLOCK) or 1
    found = None
    for p in range(passes):
        block = queries if passes == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p)
        rows = block.select("qid", F.col("vector").cast("array<double>").alias("vector")).collect()
        part = _one_pass(spark, rows, index, cells.centres, k, cells.probes if probes is None else probes, but_itself, digits)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("qid").orderBy("value", "id")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def _one_pass(spark, rows, index: DataFrame, centres: np.ndarray, k: int, probes: int, but_itself: bool, digits: int) -> DataFrame:
    ids = np.array([r["qid"] for r in rows], dtype=np.int64)
    vectors = np.array([r["vector"] for r in rows], dtype=np.float64).reshape(len(rows), -1 if rows else 0)
    asked: dict[int, np.ndarray] = {}  # cell: places of the queries that look into it
    if len(rows) and len(centres):
        near = np.concatenate([_cells_of(vectors[at : at + 4096], centres, probes) for at in range(0, len(rows), 4096)])
        place = np.repeat(np.arange(len(rows)), near.shape[1])
        order = np.argsort(near.ravel(), kind="stable")
        found, starts = np.unique(near.ravel()[order], return_index=True)
        asked = dict(zip(found.tolist(), np.split(place[order], starts[1:]), strict=True))
    held = spark.sparkContext.broadcast((ids, vectors, asked))

    def run(batches):
        import pyarrow as pa

        ids, q, asked = held.value
        value, who = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            own = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            by_cell = np.argsort(cell, kind="stable")
            names, starts = np.unique(cell[by_cell], return_index=True)
            for name, at in zip(names.tolist(), np.split(by_cell, starts[1:]), strict=True):
                every = asked.get(name, ())
                for here in (every[i : i + 512] for i in range(0, len(every), 512)):
                    y, z = q[here], x[at]
                    score = np.einsum("ij,ij->i", y, y)[:, None] + np.einsum("ij,ij->i", z, z) - 2 * (y @ z.T)
                    score = np.round(score, digits)
                    if but_itself:
                        score[ids[here][:, None] == own[at]] = np.inf
                    score = np.concatenate([value[here], score], axis=1)
                    near = np.concatenate([who[here], np.broadcast_to(own[at], (len(here), len(at)))], axis=1)
                    best = np.lexsort((near, score), axis=1)[:, :k]
                    value[here], who[here] = np.take_along_axis(score, best, axis=1), np.take_along_axis(near, best, axis=1)
        ok = np.isfinite(value)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], ok.shape)[ok]), pa.array(who[ok]), pa.array(value[ok] + 0.0)], ["qid", "id", "value"])

    return index.select("cell", "id", "vector").mapInArrow(run, "qid bigint, id bigint, value double")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact answers (qid, id) that are found; 1 if there are none."""
    both = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1.0).alias("_in")), ["qid", "id"], "left")
    share = both.agg(F.avg(F.coalesce("_in", F.lit(0.0))).alias("r")).first()["r"]
    return 1.0 if share is None else share
