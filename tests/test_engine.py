"""Columns, vectors, two tiers, the ladder of fallbacks, tables, snapshots, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.functions import cells
from runlens.functions import columns as C
from runlens.functions.vector import cosine, nearest, squared_l2
from runlens.operators import classify, knowledge, tables
from runlens.sources import documents as D


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("/a/services/services/b.md", "/a/services/b.md"), ("a\\services\\services\\b.md", "a/services/b.md"), ("/a//b/./c.md", "/a/b/c.md"), ("x", "x"), ("/a/b/../c.md", "/a/c.md"), ("/../a", "/a"), ("a/..", "."), ("../a/../..", "../.."), ("/a/..", "/"), (None, None)],
)
def test_normal_path(spark, raw, want):
    assert _one(spark, C.normal_path(F.lit(raw))) == want


@pytest.mark.parametrize(("number", "label", "want"), [(95.5, None, 95.5), (None, "High", 95.0), (None, "Normal", 75.0), (None, "Unknown", 50.0), (None, "88", 50.0), (None, None, 50.0)])
def test_confidence(spark, number, label, want):
    assert _one(spark, C.parsed_confidence(F.lit(number), F.lit(label))) == want


def test_bands_and_parts(spark):
    assert [_one(spark, C.band(F.lit(x))) for x in (80.0, 79.9, 60.0, 59.9)] == ["success", "warning", "warning", "error"]
    assert _one(spark, C.parent_name(F.lit("file.md"))) == "unknown" and _one(spark, C.stem(F.lit("/a/b.c.md"))) == "b.c"
    assert _one(spark, C.query_text(F.lit(None), F.lit("c"), F.lit("s"))) == " c s"


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    got = nearest(df.filter("id % 20 = 0").withColumnRenamed("id", "qid"), df, 3, but_itself=True).collect()
    for q in (0, 20, 40):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == q] == np.argsort(d)[:3].tolist()
    pair = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    assert pair.select(cosine("a", "b"), squared_l2("a", "b")).first()[:] == (0.0, 5.0)


def test_cells(spark):
    """Every row is indexed; recall against the exact search; with all probes the exact answers, ties and copies included."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)) + 2 * rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)]
    x[2000:2600] = x[7]  # a third of the rows in one cell
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(5)
    queries = df.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    fitted = cells.fit(df, 48, 1000)
    index = cells.placed(df, fitted)
    assert index.count() == 3000 and index.filter("cell < 0 OR cell >= 48").isEmpty()
    exact = nearest(queries, df, 5, but_itself=True)
    assert sorted(cells.search(queries, index, fitted, 5, 48, but_itself=True).collect()) == sorted(exact.collect())
    assert fitted.probes < 24 and cells.recall(cells.search(queries, index, fitted, 5, but_itself=True), exact) >= 0.9
    assert np.array_equal(fitted.centres, cells.fit(df.repartition(3), 48, 1000).centres)
    none = df.filter("id < 0")
    assert cells.fit(none).probes == 0
    assert cells.search(queries, cells.placed(none, cells.fit(none)), cells.fit(none)).isEmpty()
    assert cells.search(none.withColumnRenamed("id", "qid"), index, fitted).isEmpty()


def test_cells_of_vectors_without_clusters(spark):
    x = np.random.default_rng(6).normal(size=(2000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    queries = df.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    fitted = cells.fit(df, 64, 1500)
    found = cells.search(queries, cells.placed(df, fitted), fitted, 5, but_itself=True)
    assert cells.recall(found, nearest(queries, df, 5, but_itself=True)) >= 0.9


def test_two_tiers(spark):
    vec = "id bigint, vector array<double>"
    req = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid bigint, vector array<double>")
    learned = spark.createDataFrame([(7, [1.0, 0.1]), (8, [0.0, 1.0 + 0.4**0.5])], vec)
    official = spark.createDataFrame([(3, [0.0, 0.9])], vec)
    got = {r["qid"]: (r["source"], r["id"], r["confidence"]) for r in knowledge.two_tier(req, learned, official).collect()}
    assert got == {1: ("LEARNED", 7, 95.0), 2: ("OFFICIAL", 3, 75.0)}
    none = spark.createDataFrame([], vec)
    assert {r["source"] for r in knowledge.two_tier(req, none, none).collect()} == {"UNKNOWN"}


ANSWER = "qid bigint, method string, doc_path string, confidence double"


def _rung(spark, answer, fallbacks, paths):
    out = classify.resolved(spark.createDataFrame([answer], ANSWER), spark.createDataFrame(fallbacks, ANSWER), spark.createDataFrame([(p,) for p in paths], "path string"))
    r = out.first()
    return r["doc_path"], r["confidence"], r["source"], r["is_fallback"]


def test_every_rung_of_the_ladder(spark):
    a = (1, "VECTOR_DB", "/d/services/services/s/X.md", 75.0)
    fb = [(1, "SEMANTIC_SEARCH", "/d/services/q/Q.md", 61.0), (1, "RANDOM_FOREST", "/d/services/r/R.md", 44.0), (1, "VECTOR_DB", "/d/services/a/A.md", 99.0)]
    p = "/d/services/"
    assert _rung(spark, a, fb, [p + "s/X.md"]) == (p + "s/X.md", 75.0, "VECTOR_DB", False)
    assert _rung(spark, a, fb, [p + "q/Q.md", p + "r/R.md", p + "a/A.md"]) == (p + "q/Q.md", 61.0, "SEMANTIC_SEARCH (Fallback)", True)
    assert _rung(spark, a, fb, [p + "r/R.md", p + "a/A.md"]) == (p + "r/R.md", 44.0, "RANDOM_FOREST (Fallback)", True)
    assert _rung(spark, a, [], [p + "s/Y.md", p + "a/A.md"]) == (p + "s/Y.md", 50.0, "VECTOR_DB (Best Match)", True)
    assert _rung(spark, a, [], [p + "z/X.md", p + "a/A.md"]) == (p + "z/X.md", 50.0, "VECTOR_DB (Best Match)", True)
    assert _rung(spark, a, [], [p + "b/B.md", p + "a/A.md"]) == (p + "a/A.md", 30.0, "VECTOR_DB (Fallback - First Available)", True)
    assert _rung(spark, a, [], []) == (p + "s/X.md", 75.0, "VECTOR_DB", False)


def test_dispatch(spark):
    rows = [(1, "x", None), (2, " ", "VECTOR_DB"), (3, "x", "NOPE"), (4, "x", "RANDOM_FOREST")]
    out = classify.dispatched(spark.createDataFrame(rows, "qid bigint, snippet string, method string"), classify.METHODS[:2])
    assert {r["qid"]: r["status"] for r in out.collect()} == {1: 200, 2: 400, 3: 400, 4: 503}


def test_tables_and_snapshots(spark, tmp_path):
    kept = tables.Snapshots(spark, f"file://{tmp_path}/t", "k bigint, v string")
    assert kept.read().count() == 0
    t = kept.append(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], kept.schema))
    t = kept.replace(tables.update(t, spark.createDataFrame([(2, "B"), (3, None), (9, "z")], kept.schema), "k"))
    assert {(r["k"], r["v"]) for r in t.collect()} == {(1, "a"), (2, "B"), (3, "c")}
    t = D.listed(tables.delete(t, spark.createDataFrame([(1,)], "k bigint"), "k"), "k")
    assert {(r["k"], r["id"]) for r in t.collect()} == {(2, 0), (3, 1)}


def test_changes_that_repeat_a_key(spark):
    """Of several changes of one key one counts, and no row multiplies."""
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    twice = spark.createDataFrame([(2, "y"), (2, "x"), (2, "y"), (3, "n"), (3, "m")], "k bigint, v string")
    assert sorted(r[:] for r in tables.update(t, twice, "k").collect()) == [(1, "a"), (2, "y")]
    assert sorted(r[:] for r in tables.upsert(t, twice, "k").collect()) == [(1, "a"), (2, "y"), (3, "n")]


def test_snapshots_of_two_writers(spark, tmp_path):
    """Who publishes on what another has replaced meanwhile gets an error; old snapshots go."""
    one, two = (tables.Snapshots(spark, f"file://{tmp_path}/t", "k bigint") for _ in range(2))
    row = spark.createDataFrame([(1,)], "k bigint")
    one.append(row)
    assert two.read().count() == 1
    for _ in range(4):
        one.append(row)
    with pytest.raises(OSError):
        two.replace(row)
    assert two.append(row).count() == 6 and len(list(tmp_path.glob("t/m*"))) == tables.Snapshots.KEPT


def test_appends_write_their_own_rows(spark, tmp_path, monkeypatch):
    kept = tables.Snapshots(spark, f"file://{tmp_path}/t", "k bigint, v string")
    kept.replace(spark.range(500).selectExpr("id AS k", "repeat('x', 50) AS v"))
    first = {p.name: p.stat().st_mtime_ns for p in tmp_path.glob("t/data-*/*.parquet")}
    assert kept.append(spark.createDataFrame([(7, "a")], kept.schema)).count() == 501
    now = {p.name: p.stat().st_mtime_ns for p in tmp_path.glob("t/data-*/*.parquet")}
    assert all(now[n] == t for n, t in first.items()) and len(list(tmp_path.glob("t/data-*"))) == 2
    monkeypatch.setattr(tables.Snapshots, "MOST", 4)
    for i in range(6):
        kept.append(spark.createDataFrame([(i, "b")], kept.schema))
    assert kept.read().count() == 507 and len(kept._parts) <= 4
    kept.replace(kept.read().filter("k < 3"))
    for _ in range(tables.Snapshots.KEPT):
        kept.replace(kept.read())
    assert kept.read().count() == 6 and len(list(tmp_path.glob("t/data-*"))) == tables.Snapshots.KEPT  # nothing that nobody names


def test_a_writer_that_dies_blocks_nobody(spark, tmp_path, monkeypatch):
    """It may have written its segment, or begun its manifest: what it left isn't read, and is taken away in time."""
    kept = tables.Snapshots(spark, f"file://{tmp_path}/t", "k bigint")
    row = spark.createDataFrame([(1,)], "k bigint")
    kept.append(row)
    kept._written(row)  # a segment, and no manifest
    assert kept.append(row).count() == 2
    (tmp_path / "t" / "m000000000003").write_text("data-x")  # a manifest without its mark
    other = tables.Snapshots(spark, f"file://{tmp_path}/t", "k bigint")
    assert other.read().count() == 2
    with pytest.raises(OSError, match="is publishing"):
        other.append(row)
    monkeypatch.setattr(tables.Snapshots, "WAIT", -1)
    assert other.append(row).count() == 3 and kept.read().count() == 3


def test_scratch_tables(spark):
    from runlens.storage import durable, scratch

    with scratch(spark) as keep:
        gone, kept = durable(spark.range(3), "a"), keep(spark.range(4), "b")
    assert kept.count() == 4
    with pytest.raises(Exception, match="(?i)file|path"):
        spark.read.parquet(gone._runlens_path).count()


def test_requests_and_answers_as_json(spark):
    bodies = spark.createDataFrame([(1, '{"raw_input_snippet": "x", "method": "NOPE"}'), (2, "[1]"), (3, None), (4, '{"service": "s", "raw_input_snippet": "y"}')], "qid bigint, body string")
    got = {r["qid"]: (r["service"], r["snippet"], r["method"], r["status"]) for r in classify.dispatched(classify.decoded(bodies)).collect()}
    assert got == {1: ("", "x", "NOPE", 400), 2: ("", "", "VECTOR_DB", 400), 3: ("", "", "VECTOR_DB", 400), 4: ("s", "y", "VECTOR_DB", 200)}
    answers = spark.createDataFrame([("p", 75.0, "s", "", None), ("p", 30.0, "s", "c", "w")], "doc_path string, confidence double, source string, root_cause string, warning string")
    assert [r[0] for r in answers.select(classify.encoded(answers)).collect()] == ['{"doc_path":"p","confidence":75.0,"source":"s"}', '{"doc_path":"p","confidence":30.0,"source":"s","root_cause":"c","warning":"w"}']


def test_markdown_and_containment(spark, tmp_path):
    (tmp_path / "svc").mkdir()
    (tmp_path / "svc" / "CAT.md").write_text("שלום 🙂\nx")
    docs = D.markdown(spark, str(tmp_path))
    r = docs.first()
    assert (r["service"], r["category"], r["n_chars"]) == ("svc", "CAT", 8)
    assert D.content_of(docs, r["path"], str(tmp_path)).count() == 1
    assert D.content_of(docs, f"{tmp_path}/../svc/CAT.md", str(tmp_path)).count() == 0


def test_feedback_stream_equals_batch(spark, tmp_path):
    from runlens.streaming.feedback import feedback_stream, stored

    source, sink, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    for day in ("1", "2"):
        rows = spark.createDataFrame([(f"text {day}", "/d.md", day), ("", "/d.md", day), ("t", None, day)], "text string, correct_doc_path string, ts string")
        rows.write.mode("append").json(source)
        feedback_stream(spark, source, sink, state).awaitTermination()
    got = {(r["id"], r["text"]) for r in stored(spark, sink).collect()}
    want = knowledge.corrections(spark.read.schema("text string, correct_doc_path string, ts string").json(source))
    assert got == {(r["id"], r["text"]) for r in want.collect()} and len(got) == 2


def test_forest_save_and_load(spark, tmp_path):
    from runlens.operators import forest

    rows = forest.with_terms(spark.createDataFrame([(i, f"alpha beta {i % 2}x gamma" if i % 2 else "delta epsilon", "ab"[i % 2]) for i in range(30)], "id bigint, text string, y string"), "text")
    assert forest.load(str(tmp_path)) is None
    forest.save(forest.fit(rows, "y", features=64, depth=3, trees=5), str(tmp_path))
    out = forest.predict(forest.load(str(tmp_path)), rows.drop("y")).collect()
    assert all(r["predicted"] == "ab"[r["id"] % 2] and 50 <= r["confidence"] <= 100 for r in out)
