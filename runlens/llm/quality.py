"""Quality classifier: regularised quadratic discriminant on document statistics.

Each text gives a short vector of transformed statistics (shares smoothed towards fixed
typical values, so that very short texts are not extreme). For either label a mean and a
covariance are taken from sums over all labelled learning rows, made within the tasks; the
covariances are shrunk towards their pooled covariance and a multiple of the identity. The
score is the posterior of label 1 from the difference of the Gaussian log densities, with
Mahalanobis distances by Cholesky factors that are made once and broadcast.

What moves: doc_id and the vector of each document, to meet its label; per label and task
one row of sums.

Defined results: a null text is the empty text, which has a score like any other; without
learning rows of both labels the score is the share of label 1 (0.5 without any). Documents
are rows: repeated rows repeat their result; of several labels of a doc_id all count. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.bpe import LETTER, NUMBER
from runlens.llm.common import Rolling, chunks, code_points, durable, in_arrow, text_bytes, text_of

POOLED, RIDGE = 0.1, 0.02
#: Pseudo-counts: a share of n things counts as if PRIOR typical ones came with them.
PRIOR = 20.0
CUT = 0.7
CHUNK = 1 << 20
NAMES = ("words", "word_length", "upper", "symbols", "marks", "digits", "distinct", "repeats", "bare", "lines", "ends", "same_pairs")

_rolling = Rolling()


def _share(part, whole, typical: float):
    """Smoothed share, on the scale where its spread does not depend on its size."""
    return np.arcsin(np.sqrt(np.clip((part + PRIOR * typical) / (whole + PRIOR), 0, 1)))


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x len(NAMES)) transformed statistics of several texts."""
    from runlens.llm.bpe import _classes

    n = len(offsets) - 1
    cps, at = code_points(raw, offsets)
    kind = _classes()[cps]

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[at[1:]] - sums[at[:-1]]

    letter, digit = kind == LETTER, kind == NUMBER
    # fixed values: Latin capitals, common punctuation, marks of exclamation
    capital = ((cps >= 65) & (cps <= 90)) | ((cps >= 0xC0) & (cps <= 0xDE))
    plain = np.isin(cps, [ord(c) for c in ".,;:'\"-()?!’‘“”–—"])
    blank = np.isin(cps, [9, 10, 11, 12, 13, 32])
    marks = (cps == ord("!")) | (cps == ord("?"))
    ends = (cps == ord(".")) | marks
    symbol = ~(letter | digit | plain | blank)

    space = np.isin(raw, [9, 10, 11, 12, 13, 32])
    word = ~space
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] |= word[inner]
    stops[inner - 1] |= word[inner - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    owner = np.searchsorted(offsets, start, side="right") - 1
    count = np.bincount(owner, minlength=n)
    hashes = _rolling.spans(raw, start, stop)
    letters_before = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128))])
    bare = np.bincount(owner[letters_before[stop] == letters_before[start]], minlength=n)
    same = owner[1:] == owner[:-1]
    repeats = np.bincount(owner[1:][same & (hashes[1:] == hashes[:-1])], minlength=n)

    def distinct(h: np.ndarray, own: np.ndarray) -> np.ndarray:
        order = np.argsort(h)
        order = order[np.argsort(own[order], kind="stable")]
        h, own = h[order], own[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        return np.bincount(own[new], minlength=n)

    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[same]
    pair_owner = owner[1:][same]
    n_pairs = np.bincount(pair_owner, minlength=n)
    chars, words = total(np.ones(len(cps), dtype=bool)), np.maximum(count, 1)
    n_letters = total(letter)
    return np.column_stack(
        [
            np.log1p(count),
            np.log((total(~blank) + 5 * PRIOR) / (count + PRIOR)),
            _share(total(capital), n_letters, 0.03),
            _share(total(symbol), chars, 0.0),
            _share(total(marks), words, 0.01),
            _share(total(digit), chars, 0.01),
            np.log((distinct(hashes, owner) + PRIOR) / (words**0.8 + PRIOR)),
            _share(repeats, words, 0.0),
            _share(bare, words, 0.0),
            np.log((total(cps == 10) + 0.5) / (words + PRIOR)),
            _share(total(ends), words, 0.12),
            _share(n_pairs - distinct(pairs, pair_owner), np.maximum(n_pairs, 1), 0.03),
        ]
    ).astype(np.float64)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and stats array<double> per row."""
    source = docs.select(docs[id_col].alias("_id"), text_of(text_col).alias("_text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            at = 0
            for i, j in chunks(offsets, CHUNK):
                rows = statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * len(NAMES)), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, j - i), lists], ["_id", "stats"])
                at += j - i

    return in_arrow(source, run, f"_id {source.schema['_id'].dataType.simpleString()}, stats array<double>")


class Discriminant:
    """Means, Cholesky factors and log priors of the labels 0 and 1."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, ridge: float = RIDGE):
        n = np.array([sums[k][0] if k in sums else 0.0 for k in (0, 1)])
        self.share = float(n[1] / n.sum()) if n.sum() else 0.5
        self.ready = bool((n >= 2).all())
        if not self.ready:
            return
        d = len(NAMES)
        mean = [sums[k][1] / n[k] for k in (0, 1)]
        cov = [sums[k][2] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
        both = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
        # all statistics on the scale of their pooled spread, so that the ridge treats them alike
        self.scale = 1 / np.sqrt(np.maximum(np.diag(both), 1e-6))
        self.mean, self.factor, self.log_norm = [], [], []
        for k in (0, 1):
            own = (1 - pooled) * cov[k] + pooled * both
            own = own * self.scale[:, None] * self.scale
            own = (1 - ridge) * own + ridge * max(np.trace(own) / d, 1e-3) * np.eye(d)
            factor = np.linalg.cholesky(own)
            self.mean.append(mean[k] * self.scale)
            self.factor.append(np.linalg.inv(factor))
            self.log_norm.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Posterior of label 1."""
        if not self.ready:
            return np.full(len(stats), self.share)
        x = stats * self.scale
        log = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.mean, self.factor, self.log_norm, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label: count, sums and sums of products over all rows of (quality, stats)."""
    d = len(NAMES)

    def run(batches):
        import pyarrow as pa

        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        keys = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums.ravel())], ["at", "value"])

    flat = np.zeros(2 * (1 + d + d * d))
    for r in in_arrow(labelled.select(F.col("quality").cast("int").alias("quality"), "stats"), run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        flat[r["at"]] = r["value"]
    out = {}
    for k, row in enumerate(flat.reshape(2, -1)):
        if row[0]:
            out[k] = (row[0], row[1 : 1 + d], row[1 + d :].reshape(d, d))
    return out


def scored(described_docs: DataFrame, model: Discriminant) -> DataFrame:
    """_id and score of described rows."""
    shared = described_docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x))], ["_id", "score"])

    kind = described_docs.schema["_id"].dataType.simpleString()
    return in_arrow(described_docs.select("_id", "stats"), run, f"_id {kind}, score double")


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = durable(described(docs), "quality-stats")
    learn = labels.filter(F.col("quality").isin(0, 1) & ~apart).select(F.col("doc_id").alias("_id"), "quality")
    model = Discriminant(moments(rows.join(learn, "_id")))
    out = scored(rows, model).withColumnRenamed("_id", "doc_id")
    return out.select("doc_id", F.coalesce(apart, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
