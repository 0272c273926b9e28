"""Readers: the tolerant grammar, its golden rows, rejects, and the strict reader."""

from pyspark.sql import functions as F

from runlens.sources import records

HEADER = "Timestamp,Service,Error_Category,Raw_Input_Snippet,Root_Cause"
LINES = [
    HEADER,
    "t1,S,C,width: 3, depth: 7,Left over from a trial",
    't2,S,C,<tag name="k1",,Two separators in a row',
    "t3,S,C,points (5, 6),Mismatch - wanted a pair (x, y) not a list",
    "",
    "a,b,c",
    "a,b,c,d",
    " t4 , S , C , null , cause ",
]


def _file(tmp_path, lines=LINES):
    path = tmp_path / "records.csv"
    path.write_text("\n".join(lines))
    return str(path)


def test_lenient_golden_rows(spark, tmp_path):
    rows = {r["line_no"]: r for r in records.lenient(spark, _file(tmp_path)).collect()}
    assert sorted(rows) == [2, 3, 4, 8]
    assert (rows[2]["snippet"], rows[2]["cause"]) == ("width: 3, depth: 7", "Left over from a trial")
    assert (rows[3]["snippet"], rows[3]["cause"]) == ('<tag name="k1",', "Two separators in a row")
    assert (rows[4]["snippet"], rows[4]["cause"]) == ("points (5, 6),Mismatch - wanted a pair (x", "y) not a list")
    assert rows[8]["service"] == " S " and rows[8]["snippet"] == "null"


def test_knowledge_base_reader_strips_all(spark, tmp_path):
    last = records.lenient(spark, _file(tmp_path), strip_all=True).filter("line_no = 8").first()
    assert (last["timestamp"], last["service"], last["category"]) == ("t4", "S", "C")


def test_rejects(spark, tmp_path):
    found = {r["line_no"]: r["reason"] for r in records.rejects(spark, _file(tmp_path)).collect()}
    assert found == {5: "blank", 6: "malformed", 7: "missing_cause"}


def test_lines_are_numbered_over_splits_and_by_file(spark, tmp_path):
    for name, n in (("a.csv", 700), ("b.csv", 5)):
        (tmp_path / name).write_text("".join(f"{name} {i}\r\n" if i % 3 else "\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        rows = records.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 705
    assert sorted(r["line_no"] for r in rows if r["line"] == "") == sorted([*range(3, 701, 3), 3])
    assert all(r["line"].strip().split()[1] == str(r["line_no"]) for r in rows if r["line"])


def test_strict_truncates_at_the_comma(spark, tmp_path):
    rows = records.strict(spark, _file(tmp_path, LINES[:4])).collect()
    assert [r["snippet"] for r in rows] == ["width: 3", '<tag name="k1"', "points (5"]
    assert rows[1]["cause"] == ""


def test_json_inputs(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text('[{"Service": "S", "Raw_Input_Snippet": "x"}, {"Service": "T"}]')
    assert records.batch_inputs(spark, str(path)).filter(F.col("Raw_Input_Snippet") == "x").count() == 1
