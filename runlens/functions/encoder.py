"""The default encoder: signed hashed TF-IDF, fitted once and kept, so that all that is compared shares one state."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.postings import BREAK, merged, pieces, repeated

#: Slots of a vector.
BUCKETS = 256
#: Rows whose slots a task holds at once.
ROWS = 4096
STATE = "bucket int, idf double"


def counted(rows: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(id, _slots, _sums): per id the slots that its words fall in, and their signed counts, which may be 0.

    A word's slot comes from 32 bits of its md5, its sign from another bit, so that words which meet in a slot rather
    cancel than add. A block of texts hashes each of its words once. Write it where it is used more than once.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for ids, words in pieces(batches):
            lists = pc.split_pattern(words, " ")
            coded = lists.flatten().dictionary_encode()
            own = coded.dictionary.to_pylist()
            digits = [hashlib.md5(w.encode()).digest()[:5] for w in own]
            slot = np.array([int.from_bytes(d[:4], "big") % buckets for d in digits], dtype=np.int64)
            sign = np.array([0 if w in ("", BREAK) else 1 - 2 * (d[4] >> 4 & 1) for w, d in zip(own, digits, strict=True)], dtype=np.int64)
            code = coded.indices.to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            del lists, coded
            for i in range(0, len(ids), ROWS):
                n = min(ROWS, len(ids) - i)
                part = code[at[i] : at[i + n]]
                row = np.repeat(np.arange(n), np.diff(at[i : i + n + 1]))[sign[part] != 0]
                part = part[sign[part] != 0]
                place = row * buckets + slot[part]
                has = np.flatnonzero(np.bincount(place, minlength=n * buckets))
                sums = np.bincount(place, sign[part], n * buckets)[has]
                offsets = pa.array(np.searchsorted(has, np.arange(n + 1) * buckets).astype(np.int32))
                lists_of = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (has % buckets, sums)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, n), *lists_of], [id_col, "_slots", "_sums"])

    return merged(rows, id_col, text_col).mapInArrow(run, f"{_typed(rows, id_col)}, _slots array<int>, _sums array<int>")


def _typed(rows: DataFrame, id_col: str) -> str:
    return f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}"


def _weights(batch, idf: np.ndarray):
    """(row, slot, weight at length 1) of the slots of a batch of counted() that are not 0."""
    slots, sums = (batch.column(k) for k in (1, 2))
    lengths = slots.value_lengths().to_numpy(zero_copy_only=False)
    slot, s = (x.flatten().to_numpy(zero_copy_only=False) for x in (slots, sums))
    w = s * idf[slot]
    row, slot, w = np.repeat(np.arange(len(lengths)), lengths)[w != 0], slot[w != 0], w[w != 0]
    return row, slot, w / np.sqrt(np.bincount(row, w * w, len(lengths)))[row]


class HashedTfIdf:
    """Vectors of length 1: signed word counts times the idf of their slot. state: one row a slot, (bucket, idf)."""

    def __init__(self, state: DataFrame, buckets: int = BUCKETS):
        self.state, self.buckets = state, buckets

    @classmethod
    def fit(cls, rows: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> HashedTfIdf:
        """idf of a slot: ln((1 + n) / (1 + df)) + 1 over the n rows (texts or their counted() words), df of which have a word in it. Ids must differ."""
        counts = rows if "_slots" in rows.columns else counted(rows, id_col, text_col, buckets)
        found = counts.select(F.explode("_slots").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
        n = rows.agg(F.count(F.lit(1)).alias("n"))
        every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(found, "bucket", "left").crossJoin(F.broadcast(n))  # one row
        return cls(every.select("bucket", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1).alias("idf")), buckets)

    def save(self, path: str) -> None:
        self.state.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, buckets: int = BUCKETS) -> HashedTfIdf:
        return cls(spark.read.schema(STATE).parquet(path), buckets)

    def _idf(self) -> np.ndarray:
        """The state, which has as many rows as there are slots."""
        idf = np.zeros(self.buckets)
        for r in self.state.collect():
            idf[r["bucket"]] = r["idf"]
        return idf

    def entries(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, bucket, w) of the slots that are not 0, of texts or of their counted() words."""
        counts, idf = rows if "_slots" in rows.columns else counted(rows, id_col, text_col, self.buckets), self._idf()

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    part = batch.slice(i, ROWS)
                    row, slot, w = _weights(part, idf)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(slot), pa.array(w)], [id_col, "bucket", "w"])

        return counts.select(id_col, "_slots", "_sums").mapInArrow(run, f"{_typed(rows, id_col)}, bucket int, w double")

    def vectors(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, vector) of every row, of texts or of their counted() words; zeros where a text has no words, or those that it has cancel."""
        counts, idf, buckets = rows if "_slots" in rows.columns else counted(rows, id_col, text_col, self.buckets), self._idf(), self.buckets

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    part = batch.slice(i, ROWS)
                    row, slot, w = _weights(part, idf)
                    dense = np.zeros((part.num_rows, buckets))
                    dense[row, slot] = w
                    offsets = pa.array(np.arange(0, (part.num_rows + 1) * buckets, buckets, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(dense.ravel()))], [id_col, "vector"])

        found = counts.select(id_col, "_slots", "_sums").mapInArrow(run, f"{_typed(rows, id_col)}, vector array<double>")
        if "_slots" in rows.columns or not repeated(rows, id_col):
            return found
        own = rows.select(F.col(id_col).alias("_own"))
        return own.join(found, F.col("_own").eqNullSafe(F.col(id_col))).select(id_col, "vector")
