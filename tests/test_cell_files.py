"""The index in files: recall, what is read, hot cells, empty tables."""

import numpy as np
import pytest

from runlens.functions import cell_files, cells
from runlens.functions.vector import nearest


def _table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], "id bigint, vector array<double>")


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 64)) * 4
    x = np.repeat(centres, 60, axis=0) + rng.normal(size=(2400, 64))
    return _table(spark, x)


def test_recall_and_bytes_on_clusters(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(cell_files, "FILE_ROWS", 25)  # cells of several files
    cell_files.CellFiles.write(clustered, f"{tmp_path}/index", centres=40, sample=1200)
    index = cell_files.CellFiles(spark, f"{tmp_path}/index")
    queries = clustered.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    exact = nearest(queries, clustered, 5, but_itself=True)
    assert cells.recall(index.search(queries, 5, but_itself=True), exact) >= 0.9
    # with all cells and candidates enough only the rounding to float differs from the exact search
    assert cells.recall(index.search(queries, 5, 40, but_itself=True), exact) >= 0.99
    few = queries.filter("qid < 100")
    asked, whole = index.asked(few), index.size()
    read = index.size(asked)
    assert read["codes"] < read["vectors"] and sum(read.values()) < 0.5 * whole["vectors"]
    assert cells.recall(index.search(few, 5, but_itself=True), nearest(few, clustered, 5, but_itself=True)) >= 0.9
    plan = index._read("codes", "id bigint, code binary", asked)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan  # the other folders aren't read
    assert sum(1 for _ in (tmp_path / "index" / "codes").rglob("part-*.parquet")) > 40  # some cells are several files


def test_repeated_rows_flat_components_and_nothing(spark, tmp_path):
    rows = _table(spark, np.tile([1.0, 2.0, 3.0], (50, 1)), [*range(49), 3])
    index = cell_files.CellFiles.write(rows, f"{tmp_path}/same", centres=4, sample=20)
    got = index.search(rows.filter("id = 7").withColumnRenamed("id", "qid"), 3, but_itself=True).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2] and all(r["value"] == 0 for r in got)
    assert index.search(rows.limit(0).withColumnRenamed("id", "qid"), 3).isEmpty()
