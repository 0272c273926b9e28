"""Insert, update, delete and upsert as relational overlays, and snapshots that hold their results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def one_a_key(rows: DataFrame, key: str) -> DataFrame:
    """Of several rows of one key the greatest by the other columns, in their order, stays; rows without a key stay as they are."""
    others = [c for c in rows.columns if c != key]
    if not others:
        return rows.distinct()
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*others)).alias("_row"))
    return best.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in rows.columns]).unionByName(rows.filter(F.col(key).isNull()))


def update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Values of changes where they are not null, else the old ones; keys that table lacks are ignored.

    Of several changes of one key one_a_key picks the one that counts.
    """
    changes = one_a_key(changes, key)
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = table.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows in place of those of the same key; of several rows of one key one_a_key picks the one that counts."""
    return delete(table, rows, key).unionByName(one_a_key(rows, key))


def only_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key table lacks: an index grown by these is never built twice."""
    return rows.join(table.select(key), key, "left_anti")


class Snapshots:
    """A table kept as immutable Parquet segments; the newest whole manifest says which count.

    A writer first writes a segment aside, whatever it holds; then it creates the next manifest, a
    small file that names the table's segments and ends with a mark. That a file can be created
    once only is what makes one writer of several the next: who publishes after another has, since
    this object's last read, gets an error and nothing is lost. An append adds a segment of its own
    rows; after MOST segments they are made one. A writer that dies leaves a segment that nobody
    names, or a manifest without its mark, which others take away once it is older than WAIT
    seconds: nobody is blocked for good. The last KEPT manifests and their segments stay.
    """

    KEPT, MOST, WAIT = 3, 32, 60
    _END = "end"

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._seen: int | None = None
        self._parts: list[str] = []
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, number: int):
        return self._path(f"{self.root}/m{number:012d}")

    def _named(self, number: int) -> list[str] | None:
        """The segments that a manifest names; None if it isn't whole."""
        stream = self._fs.open(self._manifest(number))
        try:
            lines = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()
        return lines[:-1] if lines[-1] == self._END else None

    def _numbers(self) -> list[int]:
        at = self._path(self.root)
        if not self._fs.exists(at):
            return []
        return sorted(int(n[1:]) for n in (s.getPath().getName() for s in self._fs.listStatus(at)) if n.startswith("m") and n[1:].isdigit())

    @property
    def number(self) -> int:
        """Of the version that was read last; 0 before the first."""
        return self._seen or 0

    def _look(self) -> None:
        self._seen, self._parts = 0, []
        for n in reversed(self._numbers()):
            if (parts := self._named(n)) is not None:
                self._seen, self._parts = n, parts
                return

    def read(self) -> DataFrame:
        self._look()
        paths = [f"{self.root}/{p}" for p in self._parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _written(self, rows: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return name

    def _publish(self, parts: list[str], own: str) -> None:
        number = (self._seen or 0) + 1
        at = self._manifest(number)
        if self._fs.exists(at) and self._named(number) is None:
            age = self._jvm.java.lang.System.currentTimeMillis() - self._fs.getFileStatus(at).getModificationTime()
            if age > self.WAIT * 1000:  # its writer has died
                self._fs.delete(at, False)
        newer = [n for n in self._numbers() if n >= number]
        try:
            if newer:
                raise FileExistsError(newer[-1])
            out = self._fs.create(at, False)
        except Exception as e:
            self._fs.delete(self._path(f"{self.root}/{own}"), True)
            if not newer and not self._fs.exists(at):
                raise
            what = "is publishing" if self._named(max(newer, default=number)) is None else "has published"
            raise OSError(f"another writer {what} below {self.root} since it was read") from e
        out.write(bytearray("\n".join([*parts, self._END]).encode()))
        out.close()
        self._seen, self._parts = number, parts
        self._clear()

    def _clear(self) -> None:
        """Old manifests go, and the segments that only they name."""
        numbers = self._numbers()
        old, kept = numbers[: -self.KEPT], numbers[-self.KEPT :]
        used = {p for n in kept for p in self._named(n) or ()}
        for n in old:
            for p in set(self._named(n) or ()) - used:
                self._fs.delete(self._path(f"{self.root}/{p}"), True)
            self._fs.delete(self._manifest(n), False)

    def replace(self, rows: DataFrame) -> DataFrame:
        if self._seen is None:
            self._look()
        own = self._written(rows)
        self._publish([own], own)
        return self.read()

    def append(self, rows: DataFrame) -> DataFrame:
        """The table with rows of its schema more; only they are written."""
        have = self.read()
        if len(self._parts) >= self.MOST:
            return self.replace(insert(have, rows))
        own = self._written(self.spark.createDataFrame([], self.schema).unionByName(rows))
        self._publish([*self._parts, own], own)
        return self.read()
