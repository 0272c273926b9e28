"""The service end to end on a small tree: records, documents, three methods, corrections, status."""

import json

import pytest

from runlens.triage import Triage

RECORDS = """Timestamp,Service,Error_Category,Raw_Input_Snippet,Root_Cause
2025-01-01T00:00:00Z,Alpha,BAD_VALUE,height: 999 metres,Sensor - out of range
2025-01-01T00:00:01Z,Beta,BAD_TYPE,amount: "five", Input - text, not number

short,line
2025-01-01T00:00:02Z,Gamma,NO_FIELD,missing name,Client - field left out
"""


@pytest.fixture()
def triage(spark, tmp_path):
    docs = tmp_path / "docs"
    for service, category, text in (("alpha", "BAD_VALUE", "height metres range sensor"), ("beta", "OTHER", "amount text number")):
        (docs / service).mkdir(parents=True)
        (docs / service / f"{category}.md").write_text(text)
    (tmp_path / "records.csv").write_text(RECORDS)
    made = Triage(spark, f"{tmp_path}/state", str(docs))
    made.load_records(str(tmp_path / "records.csv"))
    made.load_documents()
    made.refresh_index()
    return made


REQUEST = "qid bigint, service string, category string, snippet string, method string"


def _ask(spark, triage, *rows):
    return {r["qid"]: r for r in triage.classify(spark.createDataFrame(list(rows), REQUEST)).collect()}


def test_three_methods_and_errors(spark, triage):
    triage.train(features=64, depth=3, trees=5)
    root = triage.docs_root
    got = _ask(
        spark, triage, (1, "Alpha", "BAD_VALUE", "height: 999 metres", None), (2, "Beta", "BAD_TYPE", 'amount: "five"', "VECTOR_DB"), (3, "", "", "number amount", "SEMANTIC_SEARCH"),
        (4, "Alpha", "BAD_VALUE", "height: 999 metres", "RANDOM_FOREST"), (5, "x", "y", " ", None), (6, "x", "y", "z", "NOPE"),
    )
    assert (got[1]["doc_path"], got[1]["confidence"], got[1]["source"], got[1]["root_cause"]) == (f"{root}/alpha/BAD_VALUE.md", 75.0, "OFFICIAL_KNOWLEDGE", "Sensor - out of range")
    # its own document is missing; the semantic search finds another, the cause stays
    assert (got[2]["doc_path"], got[2]["source"], got[2]["is_fallback"]) == (f"{root}/beta/OTHER.md", "SEMANTIC_SEARCH (Fallback)", True)
    assert got[2]["root_cause"] == "not number" and got[2]["warning"]
    assert (got[3]["doc_path"], got[3]["source"]) == (f"{root}/beta/OTHER.md", "SEMANTIC_SEARCH") and 0 < got[3]["confidence"] <= 100
    assert got[4]["doc_path"].startswith(root) and got[4]["status"] == 200
    assert [got[i]["status"] for i in (5, 6)] == [400, 400] and got[5]["doc_path"] is None


def test_all_requests_learned(spark, triage):
    """The second tier is asked about nothing then."""
    path = f"{triage.docs_root}/alpha/BAD_VALUE.md"
    triage.teach(spark.createDataFrame([("Beta BAD_TYPE strange words", path), ("", path), ("x", None)], "text string, correct_doc_path string"))
    got = _ask(spark, triage, (1, "Beta", "BAD_TYPE", "strange words", None))
    assert (got[1]["doc_path"], got[1]["confidence"], got[1]["source"]) == (path, 95.0, "LEARNED_MEMORY (Feedback)")
    assert triage.status().first()[:] == (True, "RF: Not loaded, Semantic: Ready", "Ready", 3, 1)


def test_unavailable_and_nothing_known(spark, tmp_path):
    bare = Triage(spark, f"{tmp_path}/state", f"{tmp_path}/docs")
    got = _ask(spark, bare, (1, "a", "b", "c", None), (2, "a", "b", "c", "RANDOM_FOREST"), (3, "a", "b", "c", "SEMANTIC_SEARCH"))
    assert [got[i]["status"] for i in (1, 2, 3)] == [503, 503, 503] and not bare.status().first()["healthy"]
    told = bare.search(spark.createDataFrame([(1, "a b c")], "qid bigint, text string")).first()
    assert (told["doc_path"], told["confidence"], told["source"]) == ("N/A", 50.0, "UNKNOWN")
    bare.teach(spark.createDataFrame([("a b c", "/x.md")], "text string, correct_doc_path string"))
    assert bare.available() == ("VECTOR_DB",) and bare.status().first()["healthy"]


def test_records(spark, triage):
    triage.update_records(spark.createDataFrame([(1, "new cause", None)], "id bigint, cause string, service string"))
    triage.delete_records(spark.createDataFrame([(0,)], "id bigint"))
    triage.add_records(spark.createDataFrame([("D", "E", "s", "c")], "service string, category string, snippet string, cause string"))
    assert [(r["id"], r["service"], r["cause"]) for r in triage.records().orderBy("id").collect()] == [(0, "Beta", "new cause"), (1, "Gamma", "Client - field left out"), (2, "D", "c")]
    with pytest.raises(KeyError):
        triage.delete_records(spark.createDataFrame([(9,)], "id bigint"))
    with pytest.raises(ValueError):
        triage.add_records(spark.createDataFrame([(None, "E", "s", "c")], "service string, category string, snippet string, cause string"))
    assert triage.refresh_index().count() == 3 and triage.refresh_index("incremental").count() == 4 and triage.refresh_index("rebuild").count() == 3


def test_documents(spark, triage):
    triage.create_document("Gamma", "NO_FIELD", "name missing")
    path = f"{triage.docs_root}/gamma/NO_FIELD.md"
    assert triage.document(path).first()["content"] == "name missing"
    triage.put_document(path, "changed")
    assert [(r["id"], r["service"], r["size"]) for r in triage.documents().orderBy("id").collect()][2] == (2, "gamma", "7 chars")
    triage.delete_documents(spark.createDataFrame([(0,)], "id bigint"))
    assert triage.documents().count() == 2
    for bad in ("/elsewhere/x.md", f"{triage.docs_root}/../x.md"):
        with pytest.raises(ValueError):
            triage.put_document(bad, "x")


def test_batch(triage, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"Timestamp": "t", "Service": "s", "Error_Category": "e", "Raw_Input_Snippet": s, "Root_Cause": "r"} for s in ("height: 999 metres", "missing name")]))
    got = triage.batch(str(tmp_path / "in.json")).orderBy("qid").collect()
    assert [r["doc_path"].rsplit("/", 1)[1] for r in got] == ["BAD_VALUE.md", "NO_FIELD.md"] and got[0]["shown"] == "75.00%"


def test_conversation(triage):
    from runlens.shell import converse

    path = f"{triage.docs_root}/beta/OTHER.md"
    lines, said = iter(["", "missing name", "n", path, "missing name", "Y", "QUIT"]), []
    assert converse(triage, lambda _: next(lines), said.append) == 1
    assert said[0].endswith("gamma/NO_FIELD.md (OFFICIAL_KNOWLEDGE, 75.00%)") and said[-1] == f"{path} (LEARNED_MEMORY (Feedback), 95.00%)"


def test_commands(spark, triage, tmp_path, capsys):
    from runlens.__main__ import main

    state = [f"{tmp_path}/other", triage.docs_root]
    main([*state, "load", f"{tmp_path}/records.csv"])
    main([*state, "teach", "odd words", f"{triage.docs_root}/alpha/BAD_VALUE.md"])
    (tmp_path / "in.json").write_text(json.dumps([{"Raw_Input_Snippet": "odd words"}]))
    main([*state, "batch", f"{tmp_path}/in.json"])
    main([*state, "status"])
    out = capsys.readouterr().out
    assert "LEARNED_MEMORY" in out and "Semantic: Ready" in out


def test_request_stream_sees_what_is_taught(spark, triage, tmp_path):
    """Two batches of the same request with a correction between them; a batch that runs again tells nothing twice."""
    from runlens.streaming import requests

    path = f"{triage.docs_root}/beta/OTHER.md"
    into, out, point = f"{tmp_path}/requests", f"{tmp_path}/answers", f"{tmp_path}/checkpoint"

    def ask(*rows):
        spark.createDataFrame(list(rows), requests.REQUEST).write.mode("append").json(into)
        requests.answer_stream(triage, into, out, point).awaitTermination()
        return {(r["batch"], r["qid"]): r for r in requests.answers(spark, out).collect()}

    first = ask((1, "Alpha", "BAD_VALUE", "height: 999 metres", None), (2, "Alpha", "BAD_VALUE", " ", None))
    assert first[0, 1]["doc_path"].endswith("alpha/BAD_VALUE.md") and first[0, 2]["status"] == 400
    taught = f"{tmp_path}/corrections"
    spark.createDataFrame([("Alpha BAD_VALUE height: 999 metres", path), ("", path)], "text string, correct_doc_path string").write.json(taught)
    requests.teach_stream(triage, taught, f"{tmp_path}/taught").awaitTermination()
    second = ask((1, "Alpha", "BAD_VALUE", "height: 999 metres", None))
    assert len(second) == 3 and (second[1, 1]["doc_path"], second[1, 1]["source"]) == (path, "LEARNED_MEMORY (Feedback)")
    # as if the driver had died after writing batch 1 and before its commit: both streams take their last batch again
    for name in ("checkpoint", "taught"):
        last = max((tmp_path / name / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    requests.answer_stream(triage, into, out, point).awaitTermination()
    requests.teach_stream(triage, taught, f"{tmp_path}/taught").awaitTermination()
    assert requests.answers(spark, out).count() == 3 and triage.corrections().count() == 1
