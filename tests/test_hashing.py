"""Counts of hashed words and word pairs against Spark ML's HashingTF."""

import random

from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from runlens.functions import hashing
from runlens.operators.forest import with_terms

ODD = [
    None, "", " ", "a", "ab", "a b c", "ab cd", "ab a cd", "AB ab\tab\n__ 12", "É éé Straße İstanbul 漢字 漢 字字字 १२ \U00010400\U00010401x",
    "x" * 5001 + " yy " + "z" * 4999, "ab " * 200_000, "q" * 700_000 + " " + "r" * 700_001,
]


def _plain(rows, features):
    return HashingTF(inputCol="terms", outputCol="_tf", numFeatures=features).transform(with_terms(rows, "text")).drop("terms", "text")


def test_hashed_counts_as_hashing_tf(spark):
    draw = random.Random(7)
    texts = ODD + ["".join(draw.choice("abcé漢 _-\U0001f600٣") for _ in range(draw.randrange(90))) for _ in range(400)]
    rows = spark.createDataFrame([(i, str(i % 3), t) for i, t in enumerate(texts)], "i int, y string, text string").repartition(3)
    for features in (hashing.FEATURES, 1000, 1):
        got = hashing.hashed(rows, "text", features)
        assert got.columns == ["i", "y", "_tf"]
        assert sorted(map(str, got.collect())) == sorted(map(str, _plain(rows, features).collect()))
    assert hashing.hashed(rows.filter("false"), "text").collect() == []


def test_hashed_makes_no_word_pairs(spark):
    """Strings of word pairs were what the forest's first stage spent its time on."""
    plan = hashing.hashed(spark.range(3).select(F.col("id").cast("string").alias("text")), "text")._jdf.queryExecution().toString()
    assert "zip_with" not in plan and "lambdafunction" not in plan


def test_hashed_is_the_same_in_small_portions(spark, monkeypatch):
    import pyarrow as pa

    words = pa.array([" ".join(f"w{i * j % 97}é" for j in range(i % 40)) + " " for i in range(200)], pa.large_string())
    whole = hashing._counts(words, 64)
    monkeypatch.setattr(hashing, "BYTES", 5)
    monkeypatch.setattr(hashing, "FEW", 0)
    assert all((a == b).all() for a, b in zip(whole, hashing._counts(words, 64), strict=True))
    at = [hashing._counts(words.slice(i, 7), 64) for i in range(0, 200, 7)]
    assert sum(int(n.sum()) for _, _, n in at) == int(whole[2].sum())
