"""Document fingerprints by winnowing (native DataFrame operations only).

A run of at most TOKEN characters without white space is one token; a longer run has a token of
TOKEN characters at every character (code point), so that its tokens do not depend on where
the run starts. The hash of K tokens is the rolling (Karp-Rabin) one: the tokens' hashes are
the digits of a number to BASE, modulo the prime P. Instead of being rolled from one position
to the next, which would tie each position to the one before, the same number is made of its
two halves (2 tokens, then 4), in log2(K) steps a position whatever K.
Of each window of W neighbouring K-gram hashes the least is chosen, the rightmost one on ties;
chosen positions are kept. A passage of K + W - 1 tokens that two texts share is therefore
always found in both fingerprints; inside a long run that is one of TOKEN + K + W - 2 characters.

A hash and its position travel as one long, hash in the high 31 bits and reversed position
in the low 31, so that the least long of a window is the rightmost least hash; windows are
taken by doubling as well.

What moves: each text once, to meet the next document by id. Documents are dealt by ranges
of doc_id whose limits are quantiles of the ids; the first document of each range also goes
to the range before it, so no range needs another one.

Defined results: null text is the empty text; a text without tokens has no hashes, and two
such fingerprints have likeness 1, one such and another 0; fewer than K tokens make one gram
of all of them, fewer than W grams one window. Documents of the same doc_id are ordered by
a hash of their text. A null doc_id sorts first. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import text_of

TOKEN = 8
K = 4
W = 4
#: Group 1 is the token at a character: TOKEN characters of a run, or a whole shorter run.
_TOKENS = rf"(?=(\S{{{TOKEN}}}|(?<!\S)\S{{1,{TOKEN - 1}}}(?!\S)))\S"
_TOP = (1 << 31) - 1
#: The rolling hash: products of two remainders stay within a long.
P = (1 << 31) - 1
BASE = 1_000_003


def _tail(a: Column, skip: int) -> Column:
    return F.slice(a, F.lit(skip + 1), F.greatest(F.size(a) - skip, F.lit(0)))


def _head(a: Column, drop: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - drop, F.lit(0)))


def _joined(width: int) -> Callable[[Column, Column], Column]:
    """The rolling hash of two neighbouring stretches, of which the right one has `width` tokens."""
    shift, prime = F.lit(pow(BASE, width, P)).cast("bigint"), F.lit(P).cast("bigint")
    return lambda left, right: (left * shift + right) % prime


def winnow(df: DataFrame, text_col: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """df with `out`: the chosen hashes with their positions, packed, in the order of the text. k and w are powers of 2."""
    tokens, grams, packed = f"_{out}_t", f"_{out}_g", f"_{out}_p"
    df = df.withColumn(tokens, F.transform(F.regexp_extract_all(F.col(text_col), F.lit(_TOKENS), F.lit(1)), lambda t: F.pmod(F.xxhash64(t), F.lit(P).cast("bigint"))))
    width, col = 1, tokens
    while width < k:
        df = df.withColumn(f"{grams}{width}", F.zip_with(_head(F.col(col), width), _tail(F.col(col), width), _joined(width)))
        col, width = f"{grams}{width}", 2 * width
    whole = F.aggregate(tokens, F.lit(0).cast("bigint"), _joined(1))
    short = F.when(F.size(tokens) == 0, F.array().cast("array<bigint>")).otherwise(F.array(whole))
    all_grams = F.when(F.size(tokens) < k, short).otherwise(F.col(col))
    pack = lambda h, i: F.shiftleft(h, 31) + (F.lit(_TOP).cast("bigint") - i)
    df = df.withColumn(packed, F.transform(all_grams, pack))
    width, col = 1, packed
    while width < w:
        df = df.withColumn(f"{packed}{width}", F.zip_with(_head(F.col(col), width), _tail(F.col(col), width), lambda a, b: F.least(a, b)))
        col, width = f"{packed}{width}", 2 * width
    few = F.when(F.size(packed) == 0, F.col(packed)).otherwise(F.array(F.array_min(packed)))
    df = df.withColumn(out, F.when(F.size(packed) < w, few).otherwise(F.array_distinct(F.col(col))))
    return df.drop(*[c for c in df.columns if c.startswith(f"_{out}_")])


def hashes(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda v: F.shiftright(v, 31)))


def positions(packed: Column) -> Column:
    return F.transform(packed, lambda v: F.lit(_TOP).cast("bigint") - v.bitwiseAND(F.lit(_TOP).cast("bigint")))


def digest(packed: Column) -> Column:
    """128 bits in hex over the chosen hashes and positions."""
    part = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(part(F.xxhash64(packed)), part(F.xxhash64(F.lit(K), packed, F.lit(W))))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two columns of distinct hashes."""
    both = F.size(F.array_intersect(F.col(a), F.col(b)))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The general operator: id, hash list and position list of each document."""
    made = winnow(docs.select(F.col(id_col), text_of(text_col).alias("_text")), "_text", "chosen")
    return made.select(id_col, F.transform("chosen", lambda v: F.shiftright(v, 31)).alias("hashes"), positions(F.col("chosen")).alias("positions"))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, _range, _extra) rows dealt by ranges of doc_id; _extra marks a range's copy of the row that follows it.

    What the driver holds is bounded by the number of ranges: their limits and first ids.
    """
    spark = docs.sparkSession
    ranges = ranges or max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = _known([i / ranges for i in range(1, ranges)], "double")
    stats = docs.agg(F.percentile_approx("doc_id", at, F.lit(100 * ranges)).alias("limits"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    limits = sorted({x for x in stats["limits"] or [] if x is not None})
    own = docs.select("doc_id", text_of("text").alias("text")).withColumn("_range", _range_of(limits)).withColumn("_extra", F.lit(0))
    firsts: list = [None] * (len(limits) + 1)
    for r in own.groupBy("_range").agg(F.min("doc_id").alias("id")).collect():
        firsts[r["_range"]] = r["id"]
    used = [i for i, x in enumerate(firsts) if x is not None]
    if stats["nulls"]:
        used = sorted({0, *used})
        firsts[0] = None  # the rows without an id come first in range 0
    before: list = [None] * len(firsts)
    for i, r in enumerate(used):
        before[r] = used[i - 1]
    earlier = F.element_at(_known(before, "int"), F.col("_range") + 1)
    is_first = F.col("doc_id").eqNullSafe(F.element_at(_known(firsts, "bigint"), F.col("_range") + 1)) & earlier.isNotNull()
    return own.unionByName(own.filter(is_first).withColumn("_range", earlier).withColumn("_extra", F.lit(1)))


def _known(values: list, kind: str) -> Column:
    """One array literal; it is folded before the query runs."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _range_of(limits: list) -> Column:
    """How many limits the id has reached, by two short searches."""
    if not limits:
        return F.lit(0)
    step = max(1, int(len(limits) ** 0.5))
    coarse = F.size(F.filter(_known(limits[step - 1 :: step], "bigint"), lambda x: x <= F.col("doc_id"))) * step
    fine = F.size(F.filter(F.slice(_known(limits, "bigint"), coarse + 1, F.lit(step)), lambda x: x <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(coarse + fine).cast("int")


def fingerprint_table(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    near = Window.partitionBy("_range").orderBy("_extra", F.col("doc_id").asc_nulls_first(), "_tie")
    rows = with_next(docs, ranges).withColumn("_tie", F.xxhash64("text"))
    rows = rows.withColumn("_next", F.lead("text").over(near)).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substr(F.coalesce("_next", F.lit("")), F.lit(1), cut)))
    rows = winnow(rows, "text", "_own")
    rows = winnow(rows, "_edited", "_new")
    rows = rows.select(
        "doc_id", "n_chars", "_range", "_extra", "_tie",
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        digest(F.col("_own")).alias("fingerprint"), digest(F.col("_new")).alias("edited_fingerprint"),
        hashes(F.col("_own")).alias("_a"), hashes(F.col("_new")).alias("_b"),
    )
    rows = rows.withColumn("_c", F.lead("_a").over(near)).withColumn("_c", F.coalesce("_c", F.array().cast("array<bigint>")))
    return rows.filter("_extra = 0").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("_a", "_b").alias("near_edited"), likeness("_a", "_c").alias("near_next")
    )
