"""The fitted encoder against its definition, and the knowledge base that shares its state."""

import hashlib
import math
import re
from collections import Counter

import pytest

from runlens.functions.encoder import HashedTfIdf, counted
from runlens.triage import Triage

TEXTS = [(1, "the pump of the reactor has stopped"), (2, "the tank of the reactor leaks"), (3, "Ünïcode wörds 漢字 here"), (4, ""), (5, None), (6, "the the the the")]


def _plain(fitted, texts, buckets):
    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % buckets
    sign = lambda w: 1 if int(hashlib.md5(w.encode()).hexdigest()[8], 16) % 2 == 0 else -1
    words = lambda t: re.findall(r"\w{2,}", (t or "").lower())
    df = Counter(b for _, t in fitted for b in {slot(w) for w in words(t)})
    out = {}
    for i, t in texts:
        v = [0.0] * buckets
        for w in words(t):
            v[slot(w)] += sign(w)
        v = [x * (math.log((1 + len(fitted)) / (1 + df[b])) + 1) for b, x in enumerate(v)]
        norm = math.sqrt(sum(x * x for x in v))
        out[i] = [x / norm if norm else 0.0 for x in v]
    return out


@pytest.mark.parametrize("buckets", [8, 256])
def test_vectors_by_definition(spark, tmp_path, buckets):
    rows = spark.createDataFrame(TEXTS, "id bigint, text string")
    HashedTfIdf.fit(rows, "id", "text", buckets).save(f"{tmp_path}/state")
    kept = HashedTfIdf.load(spark, f"{tmp_path}/state", buckets)  # another session would read the same state
    more = [*TEXTS, (7, "the reactor of another plant")]
    want = _plain(TEXTS, more, buckets)
    table = spark.createDataFrame(more, "id bigint, text string")
    got = {r["id"]: r["vector"] for r in kept.vectors(table, "id", "text").collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i]) for i in want)
    for r in kept.entries(table, "id", "text").collect():
        assert r["w"] == pytest.approx(want[r["id"]][r["bucket"]]) and r["w"]
    assert kept.vectors(table.limit(0), "id", "text").count() == 0 and HashedTfIdf.fit(table.limit(0), "id", "text", buckets).state.count() == buckets


def test_words_are_counted_next_to_the_texts(spark):
    """Texts are counted once, without an exchange of words, and serve the fit, the entries and the vectors; repeated ids are one text."""
    rows = spark.createDataFrame([*TEXTS, (2, "another tank"), (None, "no id"), (8, "a b")], "id bigint, text string")
    merged = {i: " ".join(t or "" for j, t in rows.collect() if j == i) for i in {r["id"] for r in rows.collect()}}
    counts = counted(rows, "id", "text", 8)
    plan = counted(rows.filter("id > 2"), "id", "text", 8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    fitted = HashedTfIdf.fit(counts, "id", "text", 8)
    want = _plain(list(merged.items()), list(merged.items()), 8)
    assert {r["id"]: r["vector"] for r in fitted.vectors(counts, "id", "text").collect()} == {i: pytest.approx(v) for i, v in want.items()}
    got = [(r["id"], r["vector"]) for r in fitted.vectors(rows, "id", "text").collect()]
    assert len(got) == rows.count() and all(v == pytest.approx(want[i]) for i, v in got)
    assert {(r["id"], r["bucket"]): r["w"] for r in fitted.entries(counts, "id", "text").collect()} == {(i, b): pytest.approx(x) for i, v in want.items() for b, x in enumerate(v) if x}


def _service(spark, tmp_path, causes):
    (tmp_path / "docs" / "a").mkdir(parents=True)
    (tmp_path / "docs" / "a" / "X.md").write_text("the tank of the plant")
    lines = "\n".join(f"2025-01-01T00:00:0{i}Z,A,X,{c},cause {i}" for i, c in enumerate(causes))
    (tmp_path / "records.csv").write_text("Timestamp,Service,Error_Category,Raw_Input_Snippet,Root_Cause\n" + lines)
    made = Triage(spark, f"{tmp_path}/state", f"{tmp_path}/docs")
    made.load_records(f"{tmp_path}/records.csv")
    made.load_documents()
    made.refresh_index()
    return made


def test_common_words_do_not_make_a_correction_count(spark, tmp_path):
    """A correction that shares nine of ten words, all common ones, is not near."""
    triage = _service(spark, tmp_path, [f"it is the {w} of the plant that has failed" for w in ("pump", "valve", "motor", "sensor", "relay")])
    triage.teach(spark.createDataFrame([("it is the cooler of the plant that has failed", f"{tmp_path}/docs/a/X.md")], "text string, correct_doc_path string"))
    ask = spark.createDataFrame([(1, "it is the heater of the plant that has failed"), (2, "it is the cooler of the plant that has failed")], "qid bigint, text string")
    got = {r["qid"]: r["source"] for r in triage.search(ask).collect()}
    assert got[2] == "LEARNED_MEMORY (Feedback)" and got[1] == "OFFICIAL_KNOWLEDGE"


def test_corrections_follow_a_new_state(spark, tmp_path):
    triage = _service(spark, tmp_path, ["height of 9 metres", "amount is text"])
    triage.teach(spark.createDataFrame([("an odd new thing", f"{tmp_path}/docs/a/X.md")], "text string, correct_doc_path string"))
    before = triage.corrections().first()
    triage.add_records(spark.createDataFrame([("A", "Y", "an odd old thing", "c")] * 3, "service string, category string, snippet string, cause string"))
    triage.refresh_index("rebuild")
    now = triage._current(triage.corrections()).first()
    assert before["encoder"] == 1 and triage._version() == 2 and now["vector"] != before["vector"]
    assert triage.search(spark.createDataFrame([(1, "an odd new thing")], "qid bigint, text string")).first()["confidence"] == 95.0
    assert Triage(spark, f"{tmp_path}/state", f"{tmp_path}/docs").search(spark.createDataFrame([(1, "an odd new thing")], "qid bigint, text string")).first()["confidence"] == 95.0
