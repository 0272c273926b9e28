"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features. Letters in lower case, every run of other signs as one boundary; grams of one to
three of these signs are hashed to BUCKETS; weight log(1 + count) * idf, scaled to length 1.
Features are sparse throughout: a text costs what its grams are, not BUCKETS.
Training. The document frequencies come from all learning rows. The weights are fitted with
follow-the-regularised-leader (per-coordinate FTRL-Proximal, L1 and L2 penalties) on a sample
with a share for each language: the rows of least hash of id and text, in proportion to the
language's rows but at least LEAST of each, and all of a language that has fewer. Rows
without a letter do not count. So every language with a learning row that has a letter is in
the model, whatever the table's size. Of each language every fifth row of the sample is set
aside to fit the temperature that calibrates the scores, none where there are under five.
Prediction sees nothing but the text, all of it.

What moves: one row per bucket and task for the frequencies, one per language and task for their
counts; the sample's grams and the model (BUCKETS x languages floats) through the driver,
bounded by parameters and the number of languages.

Defined results: a null text or one without a letter is `und` with score 0; so is every row
if no learning row has a language. Rows are independent; repeated rows repeat their result.
Extra columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import chunks, code_points, in_arrow, text_bytes

BUCKETS = 1 << 13
SAMPLE = 4000
#: Sampled rows a language has at least, if it has as many.
LEAST = 50
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
CHUNK = 1 << 15
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 of every other sign."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def gram_counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts (text, bucket, count), ascending by text and bucket, and whether each text has a letter."""
    n = len(offsets) - 1
    cps, at = code_points(raw, offsets)
    signs = np.zeros(len(cps) + n + 1, dtype=np.uint64)
    text = np.repeat(np.arange(n), np.diff(at))
    signs[np.arange(len(cps)) + text + 1] = _letters()[cps]  # a boundary before and after each text
    owner = np.zeros(len(signs), dtype=np.int64)
    owner[np.arange(len(cps)) + text + 1] = text
    letter = signs > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of several boundaries in a row the first
    keep[0] = True
    signs, owner, letter = signs[keep], owner[keep], letter[keep]

    kind = np.uint32 if n * BUCKETS < 1 << 32 else np.uint64
    owner = owner.astype(kind)

    def cells(h: np.ndarray, own: np.ndarray) -> np.ndarray:
        return own * kind(BUCKETS) + ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(kind)

    a, b, c = signs, signs[1:], signs[2:]
    k1, k2 = np.uint64(0x100000001B3), np.uint64(0xD6E8FEB86659FD93)
    pairs = a[:-1] * k1 * k1 + b * k1 + np.uint64(2)
    triples = a[:-2] * k2 + b[:-1] * k1 * k1 + c * k1 + np.uint64(3)
    middle = letter[1:-1]
    found = [cells(a[letter] * k1 + np.uint64(1), owner[letter]), cells(pairs[letter[1:]], owner[1:][letter[1:]]), cells(triples[middle], owner[1:-1][middle])]
    cell = np.sort(np.concatenate(found))
    new = np.flatnonzero(np.diff(cell, prepend=cell[:1] + kind(1)))
    count = np.diff(new, append=len(cell))
    cell = cell[new].astype(np.int64)
    has = np.zeros(n, dtype=bool)
    has[owner[letter]] = True
    return cell // BUCKETS, cell % BUCKETS, count, has


def _parts(column):
    """(first row, end row, texts, buckets, counts, has a letter) of the chunks of a text column."""
    raw, offsets = text_bytes(column)
    for i, j in chunks(offsets, CHUNK):
        yield i, j, *gram_counts(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def learning(docs: DataFrame) -> Column:
    """Rows that may be learnt from."""
    return F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def document_frequencies(rows: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """(rows with a letter by language, rows that have each bucket) over all rows with lang and _text."""

    def run(batches):
        import pyarrow as pa

        langs, df = Counter(), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            names = batch.column(1)
            for a, b, _, buckets, _, has in _parts(batch.column(0)):
                langs.update(lang for lang, ok in zip(names.slice(a, b - a).to_pylist(), has.tolist(), strict=True) if ok)
                df += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(df)
        kinds = [pa.array([None] * len(some) + list(langs), pa.string()), pa.array([*some.tolist(), *[-1] * len(langs)], pa.int64()), pa.array([*df[some].tolist(), *langs.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(kinds, ["lang", "bucket", "n"])

    sums = in_arrow(rows.select("_text", "lang"), run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    df, langs = np.zeros(BUCKETS, dtype=np.int64), {}
    for r in sums:
        if r["bucket"] < 0:
            langs[r["lang"]] = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return langs, df


def shares(langs: dict[str, int], sample: int) -> dict[str, int]:
    """Sampled rows of each language at most: its part of the sample, but LEAST at least."""
    total = sum(langs.values())
    return {lang: max(LEAST, -(-sample * n // total)) for lang, n in langs.items()}


def _grams_of(picked: DataFrame) -> list:
    """[(draw, lang, bucket ids, counts)] of rows of lang, _text and draw, without those that have no letter."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, values = [], []
            for a, b, texts, buckets, counts, _ in _parts(batch.column(1)):
                limits = np.searchsorted(texts, np.arange(1, b - a))
                ids += np.split(buckets, limits)
                values += np.split(counts, limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.int64()))], ["lang", "draw", "ids", "counts"])

    made = in_arrow(picked.select("lang", "_text", "draw"), run, "lang string, draw bigint, ids array<bigint>, counts array<bigint>").collect()
    return [(r["draw"], r["lang"], np.array(r["ids"], dtype=np.int64), np.array(r["counts"], dtype=np.float64)) for r in made if r["ids"]]


def _sampled(rows: DataFrame, langs: dict[str, int], sample: int):
    """[(draw, lang, bucket ids, counts)]: of each language the rows of least draw; the draw depends on doc_id and text alone."""
    share, top = shares(langs, sample), 1 << 62
    # a language of few rows is taken whole; of others twice the share is drawn, and the least of it kept
    bounds = [(lang, top if n <= 4 * share[lang] else int(top * 2 * share[lang] / n), share[lang]) for lang, n in sorted(langs.items())]
    limits = rows.sparkSession.createDataFrame(bounds, "_lang string, _bound bigint, _share int")
    drawn = rows.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit("part"), "doc_id", "_text"), 2))
    drawn = drawn.join(F.broadcast(limits), F.col("lang") == F.col("_lang")).select("lang", "_text", "draw", "_bound", "_share")
    lettered = F.col("_text").rlike(r"\p{L}")
    least = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    found = _grams_of(drawn.filter("draw < _bound").filter(lettered).dropDuplicates(["lang", "draw"]).withColumn("_at", least).filter("_at <= _share"))
    missing = sorted(set(langs) - {lang for _, lang, _, _ in found})
    if missing:  # many copies of few rows, none of them drawn: one row of each such language
        few = drawn.filter(F.col("lang").isin(missing) & lettered)
        found += _grams_of(few.groupBy("lang").agg(F.min("draw").alias("draw"), F.min_by("_text", "draw").alias("_text")))
    return sorted(found, key=lambda r: (r[0], r[1]))


class Model:
    """Languages, idf, weights (BUCKETS + 1 rows, the last one for the bias) and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def scores(self, texts: np.ndarray, buckets: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """Probabilities (n x languages) of texts with sparse counts: one product a language over the non-zero features."""
        x = np.log1p(counts) * self.idf[buckets]
        norm = np.sqrt(np.bincount(texts, x * x, minlength=n))
        x /= norm[texts]
        z = np.stack([np.bincount(texts, x * w[buckets], minlength=n) + w[-1] for w in self.weights.T.astype(np.float64)], axis=1)
        return _softmax(z / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def ftrl(samples: list, classes: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """FTRL-Proximal over [(indices, values, class)]; weights (BUCKETS + 1 x classes)."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in samples:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            g2 = g * g
            z[at] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g2
    return weights(z, n)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    low, high, golden = np.log(0.02), np.log(5.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of a documents table; None if nothing can be learnt."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).filter(learning(docs))
    counted, df = document_frequencies(rows)
    if not counted:
        return None
    total, drawn = sum(counted.values()), _sampled(rows, counted, sample)
    langs = sorted({lang for _, lang, _, _ in drawn})
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    index, samples = {lang: i for i, lang in enumerate(langs)}, []
    for _, lang, at, counts in drawn:
        x = np.log1p(counts) * idf[at]
        x /= np.sqrt((x * x).sum())
        samples.append((np.append(at, BUCKETS), np.append(x, 1.0), index[lang]))
    apart, fitted, met = [], [], Counter()
    for s in samples:
        met[s[2]] += 1
        (apart if met[s[2]] % 5 == 0 and len(samples) >= 50 else fitted).append(s)
    weights = ftrl(fitted, len(langs))
    logits = np.array([x @ weights[at] for at, x, _ in apart]).reshape(len(apart), len(langs))
    return Model(langs, idf, weights.astype(np.float32), _temperature(logits, np.array([y for _, _, y in apart], dtype=np.int64)))


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = (), made: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs with the prediction and its score, under the names `made`."""
    others = [c for c in keep if c != "text"]
    names = [f"_k{i}" for i in range(len(others))]
    source = docs.select(docs["text"].cast("string").alias("_text"), *[docs[c].alias(n) for c, n in zip(others, names, strict=True)])
    with_text = "text" in keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            langs, scores = [], []
            for a, b, texts, buckets, counts, has in _parts(batch.column(0).fill_null("")) if model else ():
                p = model.scores(texts, buckets, counts, b - a)
                best = p.argmax(axis=1)
                langs += [model.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), has.tolist(), strict=True)]
                scores += np.where(has, p[np.arange(b - a), best], 0.0).tolist()
            if not model:
                langs, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            kept = batch.columns if with_text else batch.columns[1:]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*["_text"] * with_text, *names, "_pred", "_score"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[0 if with_text else 1 :]]
    out = in_arrow(source, run, ", ".join([*kinds, "_pred string", "_score double"]))
    return out.withColumnsRenamed(dict(zip([*names, "_text", "_pred", "_score"], [*others, "text", *made], strict=True)))


def language_table(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    out = identify(docs, fit(docs, sample), ("doc_id",))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs whose language is told: not `und`, with a score of at least `least`."""
    told = identify(docs, fit(docs), tuple(docs.columns), ("__runlens_lang", "__runlens_score"))
    return told.filter((F.col("__runlens_lang") != UNKNOWN) & (F.col("__runlens_score") >= least)).select(*docs.columns)
