"""The index of cells in files: a search reads the cells that its queries look into, small codes first.

Below a folder lie the centres, one byte a component of every vector (codes), and the vectors
themselves, both in one folder a cell. A search scans the codes of the cells asked for, takes the
best CANDIDATES times k of each query by them, and compares the vectors of these. A cell of more
than FILE_ROWS rows is several files, written by as many tasks. cells.recall() holds a search
against the exact one of vector.nearest(), which needs no index.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.functions import cells
from runlens.functions.vector import squared_l2

CANDIDATES, FILE_ROWS = 8, 250_000


class CellFiles:
    """An index below `path`; write() makes one, search() looks into it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        made = spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # cells.CENTRES rows at most, and one
        head, rest = made[0], made[1:]
        size = len(head["low"])
        self.cells = cells.Cells(np.array([r["centre"] for r in rest], dtype=np.float64).reshape(len(rest), size), head["probes"])
        self.low, self.step = np.array(head["low"]), np.array(head["step"])

    @classmethod
    def write(cls, corpus: DataFrame, path: str, **options) -> CellFiles:
        """Fit cells to corpus (id, vector) and write every row that has a vector; options: of cells.fit()."""
        spark, fitted = corpus.sparkSession, cells.fit(corpus, **options)
        index = cells.placed(corpus, fitted)
        # the span of each component, over all rows, so that no code is cut off
        spans = index.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()  # a row a component
        low = np.array([r["low"] for r in spans])
        step = np.array([(r["high"] - r["low"]) / 255 or 1.0 for r in spans])
        rows = [(-1, None, fitted.probes, low.tolist(), step.tolist()), *((i, c.tolist(), None, None, None) for i, c in enumerate(fitted.centres))]
        spark.createDataFrame(rows, "cell int, centre array<double>, probes int, low array<double>, step array<double>").coalesce(1).write.parquet(f"{path}/centres")

        def code(batches):
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    codes = np.round((x - low) / step).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["cell", "id", "code"])

        parts = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("parts"))  # a row a cell
        dealt = index.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).repartition("cell", "part").select("cell", "id", "vector")
        dealt.withColumn("vector", F.col("vector").cast("array<float>")).sortWithinPartitions("cell", "id").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").parquet(f"{path}/vectors")
        coded = dealt.mapInArrow(code, "cell int, id bigint, code binary")
        coded.sortWithinPartitions("cell", "id").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").parquet(f"{path}/codes")
        return cls(spark, path)

    def asked(self, queries: DataFrame, probes: int | None = None) -> list[int]:
        """The cells that queries (qid, vector) look into: no more than there are centres."""
        held, n = self.spark.sparkContext.broadcast(self.cells.centres), self.cells.probes if probes is None else probes

        def run(batches):
            import pyarrow as pa

            found = np.zeros(len(held.value), dtype=bool)
            for batch in batches:
                if batch.num_rows and len(found):
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    found[np.unique(cells._cells_of(x, held.value, n))] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found).astype(np.int32))], ["cell"])

        vectors = queries.filter("vector IS NOT NULL").select(F.col("vector").cast("array<double>").alias("vector"))
        return sorted(r[0] for r in vectors.mapInArrow(run, "cell int").distinct().collect())

    def _read(self, name: str, schema: str, asked: list[int]) -> DataFrame:
        return self.spark.read.schema(f"{schema}, cell int").parquet(f"{self.path}/{name}").filter(F.col("cell").isin(asked))  # other folders aren't read

    def search(self, queries: DataFrame, k: int = 1, probes: int | None = None, but_itself: bool = False, digits: int = 6) -> DataFrame:
        """(qid, id, value, rank): the k nearest that the cells looked into hold, as cells.search() gives them but for what codes hide."""
        low, step = self.low, self.step
        asked = self.asked(queries, probes)

        def decode(batches):
            import pyarrow as pa

            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                x = (codes * step + low).ravel()
                at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * codes.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, pa.array(x))], ["cell", "id", "vector"])

        rough = self._read("codes", "id bigint, code binary", asked).select("cell", "id", "code").mapInArrow(decode, "cell int, id bigint, vector array<double>")
        near = cells.search(queries, rough, self.cells, k * CANDIDATES, probes, but_itself).select("qid", "id")
        vectors = self._read("vectors", "id bigint, vector array<float>", asked).select("id", "vector")
        met = near.join(vectors, "id").join(queries.select("qid", F.col("vector").alias("_q")), "qid")
        told = met.select("qid", "id", F.round(squared_l2(F.col("_q"), F.col("vector")), digits).alias("value")).distinct()
        order = Window.partitionBy("qid").orderBy("value", "id")
        return told.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)

    def size(self, asked: list[int] | None = None) -> dict[str, int]:
        """Bytes of codes and vectors in the given cells, or in all."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        length = lambda p: fs.getContentSummary(path(p)).getLength() if fs.exists(path(p)) else 0
        return {n: sum(length(f"{self.path}/{n}/cell={c}") for c in asked) if asked is not None else length(f"{self.path}/{n}") for n in ("codes", "vectors")}
