"""Exact nearest neighbours: a set of query vectors, in blocks of bounded size, against all rows of a corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are held by a task at once.
QUERY_BLOCK = 20_000
#: Queries and rows whose products a task holds at once, whatever the size of its batches.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 512, 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 1, metric: str = "l2", but_itself: bool = False, digits: int = 6) -> DataFrame:
    """(qid, id, value, rank): the k best rows of corpus (id, vector) for each of queries (qid, vector).

    value is the squared distance ("l2", least first) or the cosine ("cosine", largest first),
    rounded to `digits`; ties go to the least id. Queries are broadcast in blocks of at most
    QUERY_BLOCK; every block is one pass over the corpus, in which each task sends its k best per
    query and no more. Rows without a vector are nobody's neighbour and find none;
    nor does a vector of zeros by cosine.
    """
    spark = queries.sparkSession
    queries, corpus = queries.filter("vector IS NOT NULL"), corpus.filter("vector IS NOT NULL")
    passes = -(-queries.count() // QUERY_BLOCK) or 1
    found = None
    for p in range(passes):
        block = queries if passes == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p)
        rows = block.select("qid", F.col("vector").cast("array<double>").alias("vector")).collect()
        part = _one_pass(spark, rows, corpus, k, metric, but_itself, digits)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("qid").orderBy(F.asc("value") if metric == "l2" else F.desc("value"), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def _better(value: np.ndarray, who: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, metric: str, but_itself: bool, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, who): the best of each query so far, after the rows x with ids own."""
    score = q @ x.T
    if metric == "l2":
        score = -(np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", x, x) - 2 * score)
    else:
        with np.errstate(divide="ignore", invalid="ignore"):  # vectors of zeros
            score = score / np.sqrt(np.einsum("ij,ij->i", q, q)[:, None] * np.einsum("ij,ij->i", x, x))
    score = np.round(score, digits)
    score[np.isnan(score)] = -np.inf
    if but_itself:
        score[ids[:, None] == own] = -np.inf
    score = np.concatenate([value, score], axis=1)
    near = np.concatenate([who, np.broadcast_to(own, (len(q), len(own)))], axis=1)
    best = np.lexsort((near, -score), axis=1)[:, : value.shape[1]]
    return np.take_along_axis(score, best, axis=1), np.take_along_axis(near, best, axis=1)


def _one_pass(spark, rows, corpus: DataFrame, k: int, metric: str, but_itself: bool, digits: int) -> DataFrame:
    ids = np.array([r["qid"] for r in rows], dtype=np.int64)
    vectors = np.array([r["vector"] for r in rows], dtype=np.float64).reshape(len(rows), -1 if rows else 0)
    held = spark.sparkContext.broadcast((ids, vectors))

    def run(batches):
        import pyarrow as pa

        ids, q = held.value
        # the k best of each query so far; what a task sends doesn't grow with its rows
        value, who = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), dtype=np.int64)
        for batch in batches:
            if not len(ids) or not batch.num_rows:
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
            for i in range(0, len(own), ROWS_AT_ONCE):
                for at in range(0, len(ids), QUERIES_AT_ONCE):
                    part, some = slice(at, at + QUERIES_AT_ONCE), slice(i, i + ROWS_AT_ONCE)
                    value[part], who[part] = _better(value[part], who[part], ids[part], q[part], own[some], x[some], metric, but_itself, digits)
        ok = np.isfinite(value)
        out = -value if metric == "l2" else value
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], ok.shape)[ok]), pa.array(who[ok]), pa.array(out[ok] + 0.0)], ["qid", "id", "value"])

    return corpus.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "qid bigint, id bigint, value double")
