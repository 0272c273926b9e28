"""Counts of hashed words and word pairs, as Spark ML's HashingTF makes them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from runlens.functions.text import tokens

#: Slots of the counts.
FEATURES = 4096
#: Rows, and bytes of words, that a task counts at once.
ROWS, BYTES = 128, 1 << 19
#: Long terms that are left to finish one by one.
FEW = 16
#: What is kept of four bytes where none to three are left.
LEFT = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], dtype=np.uint32)


def _mixed(k: np.ndarray) -> np.ndarray:
    k = k * 0xCC9E2D51
    return (k << 15 | k >> 17) * 0x1B873593


def _run(h: np.ndarray, at: np.ndarray, end: np.ndarray, mixed: np.ndarray) -> None:
    """Take h on by four bytes after the other, from at to before end, in place."""
    live = np.flatnonzero(end - at >= 4)
    while len(live) > FEW:
        k = h[live] ^ mixed[at[live]]
        h[live] = (k << 13 | k >> 19) * 5 + 0xE6546B64
        at[live] += 4
        live = live[end[live] - at[live] >= 4]
    for i in live:
        one = int(h[i])
        for k in mixed[at[i] : end[i] - 3 : 4].tolist():
            one ^= k
            one = ((one << 13 | one >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
        h[i] = one
        at[i] = end[i] - (end[i] - at[i]) % 4


def _closed(h: np.ndarray, at: np.ndarray, end: np.ndarray, size: np.ndarray, fours: np.ndarray) -> np.ndarray:
    h = h ^ _mixed(fours[at] & LEFT[end - at]) ^ size.astype(np.uint32)
    h = (h ^ h >> 16) * 0x85EBCA6B
    h = (h ^ h >> 13) * 0xC2B2AE35
    return (h ^ h >> 16).view(np.int32)


def _hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """HashingTF's hashes (32 bits of Murmur3, seed 42) of the words at start to end in the bytes of text but the last one,
    and of those words near with the word after each; a pair goes on from the hash of its first word."""
    padded = np.concatenate([text, np.zeros(4, dtype=np.uint8)])
    fours = padded[:-3].astype(np.uint32)
    for i in (1, 2, 3):
        fours |= padded[i : len(padded) - 3 + i].astype(np.uint32) << 8 * i
    mixed = _mixed(fours)
    own = slice(0, len(start) - 1)
    h, at = np.full(len(start) - 1, 42, dtype=np.uint32), start[own].copy()
    _run(h, at, end[own], mixed)
    one = _closed(h, at, end[own], end[own] - start[own], fours)
    h, at, last = h[near], at[near], end[near + 1]
    _run(h, at, last, mixed)
    return one, _closed(h, at, last, last - start[near], fours)


def _counts(words, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each row's entries begin, slots, counts) of rows of words that each end with a space."""
    rows = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    text = np.frombuffer(words.buffers()[2], dtype=np.uint8)[rows[0] : rows[-1]]
    end = np.flatnonzero(text == ord(" "))
    start = np.concatenate([[0], end[:-1] + 1])
    real = end > start
    start, end = start[real], end[real]
    row = np.searchsorted(rows - rows[0], start, side="right") - 1
    # a last word of no row, so that every word has one after it
    start, end, row = (np.append(x, x[-1:]) for x in (start, end, row))
    row[-1:] = -1
    n, i = np.zeros(len(words) * features, dtype=np.int64), 0
    while i < len(start) - 1:
        j = min(len(start) - 1, max(i + 1, int(np.searchsorted(start, start[i] + BYTES))))
        near = np.flatnonzero(row[i:j] == row[i + 1 : j + 1])
        one, two = _hashes(text[start[i] : end[j]], start[i : j + 1] - start[i], end[i : j + 1] - start[i], near)
        n += np.bincount(np.concatenate([row[i:j] * features + one % features, row[i:j][near] * features + two % features]), minlength=len(n))
        i = j
    has = np.flatnonzero(n)
    return np.searchsorted(has, np.arange(len(words) + 1) * features), has % features, n[has]


def hashed(rows: DataFrame, text_col: str, features: int = FEATURES) -> DataFrame:
    """rows with the counts of their hashed terms instead of the text, as HashingTF has them; write them where they are used more than once.

    Terms are hashed where they lie in the joined words, many at a time: a word pair is never made.
    """
    from pyspark.ml.linalg import VectorUDT  # here, as workers would be long about importing it

    kept = [c for c in rows.columns if c != text_col]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            words = batch.column(len(kept)).cast(pa.large_string())
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                at, slot, n = _counts(words.slice(i, ROWS), features)
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (slot.astype(np.int32), n.astype(np.float64))]
                kind, size = (pa.array(np.full(part.num_rows, x, dtype=t)) for x, t in ((0, np.int8), (features, np.int32)))  # 0: sparse
                made = pa.StructArray.from_arrays([kind, size, *lists], ["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], [*kept, "_tf"])

    words = F.concat(F.array_join(tokens(F.col(text_col)), " "), F.lit(" ")).alias("_words")
    schema = StructType([*(rows.schema[c] for c in kept), StructField("_tf", VectorUDT())])
    return rows.select(*kept, words).mapInArrow(run, schema)
