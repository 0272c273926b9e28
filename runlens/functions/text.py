"""Words, n-grams and TF-IDF as relations; large tables are counted by functions/postings.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: two or more letters, digits or underscores of any script.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by one space."""
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(first, rest, lambda a, b: F.concat(a, F.lit(" "), b))


def term_counts(rows: DataFrame, id_col: str, text_col: str, ngrams: int = 2) -> DataFrame:
    """(id, term, tf) of words and, for ngrams 2, word pairs."""
    words = rows.select(id_col, tokens(F.col(text_col)).alias("_w"))
    terms = F.concat("_w", bigrams(F.col("_w"))) if ngrams == 2 else F.col("_w")
    return words.select(id_col, F.explode(terms).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def idf_of(counts: DataFrame, documents: int) -> DataFrame:
    """counts (term, df) with idf: ln((1 + n) / (1 + df)) + 1."""
    return counts.withColumn("idf", F.log((F.lit(1.0) + documents) / (F.lit(1.0) + F.col("df"))) + 1)


def buckets_of(rows: DataFrame, id_col: str, text_col: str, buckets: int = 256) -> DataFrame:
    """(id, bucket, n): words counted by 32 bits of md5; the default encoder, without a model."""
    slot = F.pmod(F.conv(F.substring(F.md5("_t"), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
    words = rows.select(id_col, F.explode(tokens(F.col(text_col))).alias("_t"))
    return words.groupBy(id_col, slot.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def hashed_vectors(rows: DataFrame, id_col: str, text_col: str, buckets: int = 256) -> DataFrame:
    """(id, vector): the hashed word counts as one vector of length 1 per id; a text without words has zeros."""
    entries = F.collect_list(F.struct(F.col("bucket"), F.col("n").cast("double")))  # one a bucket at most
    counts = buckets_of(rows, id_col, text_col, buckets).groupBy(id_col).agg(F.map_from_entries(entries).alias("_m"))
    norm = F.sqrt(F.aggregate(F.map_values("_m"), F.lit(0.0), lambda s, x: s + x * x))
    dense = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.try_element_at(F.col("_m"), b.cast("bigint")), F.lit(0.0)) / norm)
    found = counts.select(id_col, dense.alias("vector"))
    return rows.select(id_col).join(found, id_col, "left").select(id_col, F.coalesce("vector", F.array_repeat(F.lit(0.0), buckets)).alias("vector"))
