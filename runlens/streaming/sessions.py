"""Sessions of a keyed stream: rows of a key less than a gap apart, with a watermark, late rows kept aside.

The state of every key (its open sessions) is a table, one version a micro-batch, in the folder that
the stream owns; so are the closed sessions and the late rows. A version is named after its batch
and written whole before the batch is marked as done, so a batch that runs again after a failure
replaces what it had left and nothing is told twice.

The watermark of a batch is the latest time of the batches before it less a delay. A row is late if
it is older: it goes to the side table and into no session. A session is closed once its end lies
before the watermark, so no row that is on time can still reach it: what the stream tells is what
sessions_of() makes of the rows that were on time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.temporal import micros


def _cells(rows: DataFrame, by: list[str], time: str, gap: int, sums: list[str]) -> DataFrame:
    """One row for each key and cell of time as long as a gap: all of such a cell is one session, so a hot key shrinks before it is dealt out."""
    at = micros(time)
    timed = rows.filter(F.col(time).isNotNull()).withColumns({"_at": at, "_cell": F.floor(at / (gap * 1_000_000))})
    return timed.groupBy(*by, "_cell").agg(F.min("_at").alias("_start"), (F.max("_at") + gap * 1_000_000).alias("_end"), F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in sums]).drop("_cell")


def _merged(pieces: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Sessions of pieces (_start, _end, n, sums): those that touch are one."""
    span = F.concat((F.col("_end") - F.col("_start")).cast("string"), F.lit(" microseconds"))
    window = F.session_window(F.timestamp_micros("_start"), span)
    merged = pieces.groupBy(*by, window.alias("_w")).agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])
    return merged.select(*by, F.unix_micros("_w.start").alias("_start"), F.unix_micros("_w.end").alias("_end"), "n", *sums)


def _shown(sessions: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    return sessions.select(*by, F.timestamp_micros("_start").alias("start"), F.timestamp_micros("_end").alias("end"), "n", *sums)


def sessions_of(rows: DataFrame, by: list[str], time: str, gap: int, sums: list[str] = ()) -> DataFrame:
    """(key, start, end, n, sums) of a table: end is the last row's time and the gap, in seconds. Rows without a time are in none."""
    sums = list(sums)
    return _shown(_merged(_cells(rows, by, time, gap, sums), by, sums), by, sums)


class SessionStream:
    """Sessions below `root`: take() is one micro-batch, run() a stream of them.

    schema: of the rows; sums: columns that are added up per session; gap and delay in seconds.
    """

    def __init__(self, spark: SparkSession, root: str, schema, by: list[str], time: str, gap: int, delay: int, sums: list[str] = ()):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.by, self.time, self.gap, self.delay, self.sums = by, time, gap, delay, list(sums)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self) -> list[int]:
        """The batches that are marked, ascending."""
        at = self._path(f"{self.root}/marks")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())

    def _piece_schema(self):
        made = _cells(self.spark.createDataFrame([], self.schema), self.by, self.time, self.gap, self.sums)
        return _merged(made, self.by, self.sums).schema

    def _read(self, name: str, batches: list[int], schema) -> DataFrame:
        there = [p for p in (f"{self.root}/{name}/{b}" for b in batches) if self._fs.exists(self._path(p))]
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)

    def _latest(self, done: list[int]) -> int | None:
        """The latest time, in microseconds, of the batches so far."""
        return self._read("marks", done[-1:], "latest bigint").first()[0] if done else None

    def take(self, batch: DataFrame, number: int) -> None:
        """Micro-batch `number`, the next one or the last one again."""
        done = [d for d in self._done() if d < number]
        latest = self._latest(done)
        mark = latest - self.delay * 1_000_000 if latest is not None else None
        batch = batch.select(*[f.name for f in self.spark.createDataFrame([], self.schema).schema])
        batch.persist()
        try:
            late = F.lit(False) if mark is None else F.coalesce(micros(self.time) < mark, F.lit(False))
            batch.filter(late).write.mode("overwrite").parquet(f"{self.root}/late/{number}")
            newest = batch.agg(F.max(micros(self.time))).first()[0]
            latest = max((x for x in (latest, newest) if x is not None), default=None)
            schema = self._piece_schema()
            before = self._read("open", done[-1:], schema)
            pieces = _merged(before.unionByName(_cells(batch.filter(~late), self.by, self.time, self.gap, self.sums)), self.by, self.sums)
            pieces.write.mode("overwrite").parquet(f"{self.root}/all/{number}")
        finally:
            batch.unpersist()
        every = self._read("all", [number], schema)
        closed = F.lit(False) if latest is None else F.col("_end") < latest - self.delay * 1_000_000
        every.filter(closed).write.mode("overwrite").parquet(f"{self.root}/closed/{number}")
        every.filter(~closed).write.mode("overwrite").parquet(f"{self.root}/open/{number}")
        self.spark.createDataFrame([(latest,)], "latest bigint").write.mode("overwrite").parquet(f"{self.root}/marks/{number}")
        self._fs.delete(self._path(f"{self.root}/all/{number}"), True)
        for old in done[:-1]:  # the last one's state is what this batch would start from again
            self._fs.delete(self._path(f"{self.root}/open/{old}"), True)

    def run(self, stream: DataFrame, checkpoint: str):
        """Take all that lies in the stream's source, and end."""
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def closed(self) -> DataFrame:
        return _shown(self._read("closed", self._done(), self._piece_schema()), self.by, self.sums)

    def open(self) -> DataFrame:
        return _shown(self._read("open", self._done()[-1:], self._piece_schema()), self.by, self.sums)

    def late(self) -> DataFrame:
        return self._read("late", self._done(), self.schema)
