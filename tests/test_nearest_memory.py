"""What a search holds beside its input does not grow with the rows of a batch."""

import tracemalloc

import numpy as np
from runlens.functions import vector


def _peak(spark, rows, monkeypatch):
    made = {}

    class Corpus:  # takes the task's function instead of running it
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            made["run"] = run

    queries = [{"qid": i, "vector": [float(i % 7)] * 16} for i in range(600)]
    vector._one_pass(spark, queries, Corpus(), 1, "l2", False, 6)
    import pyarrow as pa

    x = np.random.default_rng(1).random(rows * 16)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), pa.ListArray.from_arrays(pa.array(np.arange(0, rows * 16 + 1, 16, dtype=np.int32)), pa.array(x))], ["id", "vector"])
    tracemalloc.start()
    (out,) = made["run"](iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    q, v = np.array([r["vector"] for r in queries]), x.reshape(rows, 16)
    best = np.round(((q[:, None, :] - v[None]) ** 2).sum(axis=2), 6).min(axis=1) if rows < 4000 else None
    if best is not None:
        assert np.allclose(out.column(2).to_numpy(), best, atol=2e-6)
    return peak


def test_memory_of_a_batch_is_bounded(spark, monkeypatch):
    small, large = (_peak(spark, n, monkeypatch) for n in (2000, 20000))
    assert large < 60e6 and large < 2 * small, (small, large)
