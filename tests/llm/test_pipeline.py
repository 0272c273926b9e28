"""The pipeline against a plain version of what each stage keeps, and the registered queries."""

import hashlib
import os

import pytest
from helpers import awkward, near_components

import corpus_pipeline
from runlens.llm import language_id, mixing, queries

DATA = "/root/testdata/sf0.001"


def test_pipeline_by_hand(spark, tmp_path):
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    told = language_id.known_language(docs).collect()
    last = {}
    for r in told:
        if r["text"] not in last or (last[r["text"]]["doc_id"] or -1) < (r["doc_id"] or -1):
            last[r["text"]] = r
    groups = near_components([(r["doc_id"], r["text"]) for r in last.values() if r["doc_id"] is not None], 5, 80)
    kept = [r for r in last.values() if r["doc_id"] is None or groups[r["doc_id"]][1] == r["doc_id"]]
    plan = mixing.mix_table(spark.createDataFrame(kept, docs.schema)).collect()
    text = {r["doc_id"]: r["text"] for r in kept}
    want = sorted((str(r["doc_id"]), hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()) for r in plan for _ in range(r["copies"]))
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in got) == want


def test_near_stage_tells_rows_by_id_and_text(spark, tmp_path):
    """Ids that repeat: a near copy goes though another text of its id stays; of two near texts of one id one stays."""
    base = [f"word{i}" for i in range(60)]
    near, other, twin = [*base[:59], "changed"], [f"other{i}" for i in range(40)], [*base[:58], "so", "on"]
    rows = [(7, base), (9, other), (9, near), (7, twin), (None, base), (None, None), (3, [])]
    docs = spark.createDataFrame([(i, " ".join(t) if t is not None else None, "x") for i, t in rows], "doc_id bigint, text string, lang string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_stage(spark, docs, str(tmp_path)).collect()), key=str)
    assert (9, " ".join(other)) in got and (9, " ".join(near)) not in got
    assert sum(i == 7 for i, _ in got) == 1 and len([1 for i, _ in got if i is None]) == 2 and (3, "") in got and len(got) == 5


def test_pipeline_of_nothing(spark, tmp_path):
    awkward(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.sql(queries.oracle_sql()[name]).fetchdf()
    cols = sorted(want.columns)
    got, want = (d[cols].sort_values(cols, ignore_index=True) for d in (got, want))
    assert len(got) == len(want)
    for c in cols:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
