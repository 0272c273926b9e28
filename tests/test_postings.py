"""Counts in blocks: what is exchanged grows with terms and blocks, not with entries; results equal a plain count."""

import math
import re
from collections import Counter

import pytest

from runlens.functions import postings
from runlens.functions import text as T

ROWS = [(1, "One two two one two"), (2, None), (3, ""), (4, "two"), (4, "one two"), (5, "zwölf a b größe"), (None, "one"), (6, "One two two one two")]


def _plain(rows):
    found = {}
    for i, text in rows:
        words = [w for w in re.findall(r"\w{2,}", (text or "").lower())]
        found.setdefault(i, Counter()).update(words + [" ".join(p) for p in zip(words, words[1:])])
    return found


@pytest.mark.parametrize("block", [1, 1 << 24])
def test_totals_and_weights_with_repeated_ids(spark, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    counts = _plain(ROWS)
    n, df = Counter(), Counter()
    for c in counts.values():
        n.update(c)
        df.update(set(c))
    assert {(r.term, r.n, r.df) for r in postings.totals(docs, "doc_id", "text").collect()} == {(t, n[t], df[t]) for t in n}
    assert {r.term for r in postings.totals(docs, "doc_id", "text", single=False).collect()} == {t for t in n if " " in t}
    idf = {t: math.log((1 + len(ROWS)) / (1 + df[t])) + 1 for t in df}
    want = {(i, t): f * idf[t] / math.sqrt(sum((g * idf[u]) ** 2 for u, g in c.items())) for i, c in counts.items() for t, f in c.items()}
    got = {(r.id, r.term): r.w for r in postings.Postings(docs, "doc_id", "text").weights().collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_term_of_all_documents_is_one_row_a_block(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'all have these words' AS text").coalesce(2)
    found = postings.Postings(docs, "doc_id", "text")
    assert found.terms.count() <= 2 * 7 and found.terms.agg({"n": "sum"}).first()[0] == 3000 * 7
    assert postings.totals(docs, "doc_id", "text").filter("df = 3000 AND n = 3000").count() == 7


@pytest.mark.parametrize("meeting", [1, 7, 1 << 22])
def test_best_by_blocks(spark, monkeypatch, meeting):
    monkeypatch.setattr(postings, "MEETING", meeting)
    rows = [(i, " ".join(f"w{(i * k) % 11}x" for k in range(1, 6))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    found = postings.Postings(docs, "doc_id", "text")
    items = T.term_counts(docs.filter("doc_id % 4 = 1"), "doc_id", "text").withColumnRenamed("doc_id", "id")
    best = found.best(found.weighed(items), k=3).collect()
    w = {}
    for r in found.weights().collect():
        w.setdefault(r.id, {})[r.term] = r.w
    for q in range(1, 40, 4):
        scores = sorted((-round(sum(x * w[d].get(t, 0) for t, x in w[q].items()), 6), d) for d in w)
        want = [(d, -s) for s, d in scores if s < 0][:3]
        got = [(r.id, r.score) for r in sorted((r for r in best if r["query"] == q), key=lambda r: r["rank"])]
        assert [g[0] for g in got] == [x[0] for x in want] and all(abs(g[1] - x[1]) < 2e-6 for g, x in zip(got, want))


def _exchanged(df) -> int:
    """Bytes that a run of df writes for its exchanges."""
    sc = df.sparkSession.sparkContext._jsc.sc()
    so_far = lambda: sc.listenerBus().waitUntilEmpty(30_000) or sc.statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = so_far()
    df.write.format("noop").mode("overwrite").save()
    return so_far() - before


def _many_pairs(spark):
    """1,000 texts of 200 words out of 4,999, nearly all of their 199,000 word pairs different."""
    word = "transform(sequence(0, 199), i -> concat('w', pmod(xxhash64(id, i), 4999)))"
    return spark.range(1000).selectExpr("id AS doc_id", f"concat_ws(' ', {word}) AS text").coalesce(2)


def test_weights_exchange_little_and_write_nothing(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 1 << 18)
    written = []
    monkeypatch.setattr(postings, "durable", lambda df, name, keep=postings.durable: written.append(name) or keep(df, name))
    docs = _many_pairs(spark)
    weights = postings.Postings(docs, "doc_id", "text").weights()
    assert not written
    size = docs.selectExpr("sum(length(text))").first()[0]
    assert _exchanged(weights) < 3.5 * size


def test_totals_exchange_terms_in_packed_texts(spark):
    docs = _many_pairs(spark)
    counted = postings.totals(docs, "doc_id", "text")
    assert _exchanged(counted) < 8 * counted.count()


def test_texts_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b"), (3, "")], "doc_id long, text string")
    for some in (docs, docs.filter("doc_id > 3")):
        assert postings.totals(some, "doc_id", "text").count() == 0 and postings.Postings(some, "doc_id", "text").weights().count() == 0
