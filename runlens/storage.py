"""Shared storage: the folder that all machines see, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none: a private one, if all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="runlens-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_remove, spark, found)
    return found.rstrip("/")


#: Folders of the open scratch blocks, the innermost last.
_scratch: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed at the end of the scratch block or else of the driver's Python."""
    path = f"{shared_dir(spark)}/runlens-{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    atexit.register(_remove, spark, path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose written tables are removed when it ends, but those written by the function it gives.

    What leaves the block must rest on such kept tables alone.
    """
    own: list[str] = []
    _scratch.append(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _scratch.pop()
        try:
            return durable(df, name)
        finally:
            _scratch.append(inner)

    try:
        yield keep
    finally:
        _scratch.remove(own)
        for path in own:
            _remove(spark, path)


def drop(df: DataFrame) -> None:
    """Remove the written table behind a DataFrame of durable(); of others nothing."""
    if path := getattr(df, "_runlens_path", None):
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have gone first
        pass


def durable(df: DataFrame, name: str, light: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and fixes generated ids.

    A lost executor then costs the tasks that read its part, never a second, different run
    of what assigned the ids. light: rows of a few numbers, far smaller than what they are made
    from; they are written by an eighth of the shuffle's tasks, so that their files are not tiny.
    """
    spark = df.sparkSession
    if light:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._runlens_path = path
    return written


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within the block a query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """df on all cores: dealt out where its scan has fewer tasks than the session has cores, as it is read where it has enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
