"""Helpers shared by the training-data operators: tables, hashes, Arrow text access."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.storage import drop, durable, new_folder, scratch, shared_dir

__all__ = ["Rolling", "chunks", "code_points", "drop", "durable", "give_back", "in_arrow", "mix64", "new_folder", "scratch", "shared_dir", "stream64", "table", "text_bytes", "text_of"]

#: A word of the contracts: a run without space, tab, LF, VT, FF or CR.
WORD = r"[^\x20\x09-\x0D]+"
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """Null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: None


def give_back() -> None:
    """Memory that a worker has freed goes back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _trim()(0)


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema); what a task has freed goes back to the system when it ends.

    Workers are used again by later stages; kept memory would add up with what those need.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64, in place on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64, the same in every process."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & _MASK))


class Rolling:
    """Substring hashes over a symbol array by prefix sums of T[symbol] * P**position, modulo 2**64.

    T maps a byte to 64 random bits, so that equal sums of small differences cannot cancel.
    """

    P = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.table = stream64(256, 7)
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 2 * len(self.up))
        inverse = pow(self.P, -1, 1 << 64)
        for name, base in (("up", self.P), ("down", inverse)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def spans(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of symbols[start:end] for each span; symbols are bytes."""
        return self.between(self.prefix(self.table[symbols]), start, end)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """The sums for between(), over values of 64 random bits."""
        self._grow(len(values) + 1)
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return sums

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of values[start:end] for each span."""
        h = (sums[end] - sums[start]) * self.down[start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of n + 1) of an Arrow string column without nulls, without copies."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int):
    """(first row, end row) of runs of rows with about `most` bytes; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of several texts to (uint32 code points, offsets in code points)."""
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    return cps, starts[offsets]
