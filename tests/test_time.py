"""Joins and frames in time, sessions, levels, sketches and differences against plain versions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runlens.operators import differences, levels, temporal
from runlens.streaming.sessions import SessionStream, sessions_of

T0 = datetime(2025, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().toString()


def _rows(n, seed, keys=("a", "b", None)):
    rng = random.Random(seed)
    return [(i, rng.choice(keys), T0 + timedelta(seconds=rng.randint(0, 50_000)) if rng.random() < 0.95 else None, rng.randint(0, 9)) for i in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    left, right = _rows(300, 1), _rows(120, 2)
    make = lambda rows: spark.createDataFrame(rows, "id bigint, k string, ts timestamp, v int")
    return left, right, make(left), make(right)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("block", [60, 3600, 10**7])
def test_as_of(tables, inclusive, block):
    left, right, a, b = tables
    got = {r["id"]: (r["_w"], r["_i"]) for r in temporal.as_of(a, b.withColumnsRenamed({"v": "_w", "id": "_i"}), ["k"], "ts", ["_w", "_i"], block, inclusive).collect()}
    for i, k, t, _ in left:
        fits = [(s, w, j) for j, q, s, w in right if k is not None and q == k and s is not None and t is not None and (s <= t if inclusive else s < t)]
        assert got[i] == (max(fits)[1:] if fits else (None, None))


def test_as_of_without_rows_and_its_plan(tables):
    _, _, a, b = tables
    assert temporal.as_of(a, b.limit(0).withColumnRenamed("v", "w"), ["k"], "ts", ["w"]).filter("w IS NOT NULL").count() == 0
    assert temporal.as_of(a.limit(0), b.withColumnRenamed("v", "w"), ["k"], "ts", ["w"]).count() == 0
    plan = _plan(temporal.as_of(a, b.withColumnRenamed("v", "w"), ["k"], "ts", ["w"]))
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("cell", [1, 60, 5000])
def test_holding(spark, tables, cell):
    left, _, a, _ = tables
    rng = random.Random(5)
    spans = [(i, rng.choice(["a", "b", None]), T0 + timedelta(seconds=rng.randint(0, 50_000)), rng.choice([0, 1, 50, 4000, 10**6, -5])) for i in range(60)]
    spans = [(i, k, s, s + timedelta(seconds=d)) for i, k, s, d in spans] + [(99, "a", None, T0)]
    made = spark.createDataFrame(spans, "span bigint, k string, s timestamp, e timestamp")
    met = temporal.holding(a, made, ["k"], "ts", "s", "e", cell)
    want = sorted((i, n) for i, k, t, _ in left for n, q, s, e in spans if k is not None and k == q and None not in (t, s) and s <= t < e)
    assert sorted((r["id"], r["span"]) for r in met.collect()) == want  # each pair once
    assert "Cartesian" not in _plan(met) and "NestedLoop" not in _plan(met)
    assert temporal.holding(a, made.limit(0), ["k"], "ts", "s", "e").count() == 0


@pytest.mark.parametrize("width,block", [(600, 60), (600, 3600), (40_000, 60), (0, 60)])
def test_trailing(tables, width, block):
    left, _, a, _ = tables
    got = temporal.trailing(a, ["k"], "ts", width, {"n": F.count(F.lit(1)), "s": F.sum("v")}, block).collect()
    assert len(got) == len(left)
    for r in got:
        near = [v for _, k, t, v in left if k == r["k"] and None not in (t, r["ts"]) and timedelta(0) <= r["ts"] - t <= timedelta(seconds=width)]
        assert (r["n"], r["s"]) == ((len(near), sum(near)) if r["ts"] else (None, None))


def _sessions(rows, gap):
    out, by = [], {}
    for _, k, t, v in rows:
        if t is not None:
            by.setdefault(k, []).append((t, v))
    for k, own in by.items():
        run = []
        for t, v in sorted(own):
            if run and t - run[-1][0] > timedelta(seconds=gap):
                out.append((k, run[0][0], run[-1][0] + timedelta(seconds=gap), len(run), sum(x for _, x in run)))
                run = []
            run.append((t, v))
        out.append((k, run[0][0], run[-1][0] + timedelta(seconds=gap), len(run), sum(x for _, x in run)))
    return sorted(out, key=str)


def _told(df):
    return sorted((tuple(r) for r in df.select("k", "start", "end", "n", "v").collect()), key=str)


def test_sessions_of_a_table(tables):
    left, _, a, _ = tables
    for gap in (10, 300, 5000):
        assert _told(sessions_of(a, ["k"], "ts", gap, ["v"])) == _sessions(left, gap)


def test_session_stream_equals_the_batch(spark, tmp_path):
    """Five batches in the order of time but for a fifth that comes two batches late; one batch fails before its mark and runs again."""
    rng = random.Random(4)
    rows = sorted(_rows(400, 3), key=lambda r: r[2] or T0)
    parts = [[] for _ in range(5)]
    for i, r in enumerate(rows):
        parts[min(4, i // 80 + (2 if rng.random() < 0.2 else 0))].append(r)
    schema = "id bigint, k string, ts timestamp, v bigint"
    stream = SessionStream(spark, f"{tmp_path}/state", schema, ["k"], "ts", 300, 4000, ["v"])
    on_time, late, latest = [], [], None
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    for n, part in enumerate(parts):
        mark = latest - timedelta(seconds=4000) if latest else None
        late += [r for r in part if mark and r[2] and r[2] < mark]
        on_time += [r for r in part if not (mark and r[2] and r[2] < mark)]
        latest = max([t for _, _, t, _ in part if t] + ([latest] if latest else []))
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        if n == 2:  # as if the driver had died after writing and before the mark
            before = stream._fs.delete
            stream.take(spark.createDataFrame(part, schema), n)
            before(stream._path(f"{tmp_path}/state/marks/{n}"), True)
        stream.run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/checkpoint").awaitTermination()
        assert _told(stream.closed().unionByName(stream.open())) == _sessions(on_time, 300)
    assert sorted(r["id"] for r in stream.late().collect()) == sorted(r[0] for r in late) and late
    assert stream.closed().count() > 5 and stream._done() == list(range(5))
    assert len(list((tmp_path / "state" / "open").iterdir())) <= 2


def test_levels_and_their_sums(spark, tables):
    _, _, a, _ = tables
    rows = a.select("k", F.col("v").alias("w"), F.hour("ts").alias("h"), F.lit(2).alias("x"))
    dims = ["k", "w", "h"]
    whole = levels.levels(rows, dims, ["x"])
    halves = [levels.levels(rows.filter(F.pmod(F.hash("k", "w", "h"), F.lit(2)) == i), dims, ["x"]) for i in (0, 1)]
    same = levels.added(*halves, dims, ["x"])
    assert sorted(map(str, same.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert whole.filter("level = 7").first()["n"] == 300
    assert _plan(levels.levels(rows, dims, ["x"])).split("== Physical Plan ==")[1].count("Exchange") == 1  # one shuffle


def test_sketches_come_near(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 40).alias("h"), (F.col("id") * 7919 % 50_021).alias("who"), (F.col("id") * 31 % 1000).cast("double").alias("value"))
    kept = levels.sketched(rows, ["g", "h"], "who", "value")
    about = {r["g"]: r for r in levels.told(levels.merged(kept, ["g"]), {"median": 0.5, "high": 0.9}).collect()}
    for r in levels.exact(rows, ["g"], "who", "value", {"median": 0.5, "high": 0.9}).collect():
        got = about[r["g"]]
        assert got["n"] == r["n"] and abs(got["who"] - r["who"]) <= 0.03 * r["who"]
        assert abs(got["median"] - r["median"]) <= 15 and abs(got["high"] - r["high"]) <= 15  # values are spread evenly: ranks within 1.5 %


def test_differences(spark):
    old = [(1, "a", None), (1, "a", None), (2, "b", 1), (3, "c", 1), (None, "n", 2), (None, "n", 2), (5, "same", 5)]
    new = [(1, "a", None), (2, "B", 1), (4, "d", None), (4, "d", None), (None, "n", 2), (None, "m", 3), (5, "same", 5)]
    make = lambda rows: spark.createDataFrame(rows, "k int, v string, w int")
    made = differences.difference(make(old), make(new), "k")
    got = sorted(map(str, ((r["k"], r["v"], r["change"], r["kind"]) for r in made.collect())))
    assert got == sorted(map(str, [(1, "a", -1, "deleted"), (2, "b", -1, "changed"), (2, "B", 1, "changed"), (3, "c", -1, "deleted"), (4, "d", 2, "inserted"), (None, "n", -1, "changed"), (None, "m", 1, "changed")]))
    assert sorted(map(str, (tuple(r) for r in differences.applied(make(old), made).collect()))) == sorted(map(str, new))
    assert differences.difference(make(old), make(old), "k").count() == 0
    assert differences.applied(make([]), differences.difference(make([]), make(new), "k")).count() == len(new)


def _dense(spark):
    return spark.range(6000).selectExpr("id", "id % 2 AS k", "timestamp_micros((id * 7919) % 9000 * 1000000 + 1) AS ts", "CASE WHEN id % 5 > 0 THEN id % 3 END AS v")


def test_trailing_sums_equal_totals_and_add_up_once(spark):
    rows = _dense(spark)
    sums = {"n": F.lit(1), "s": F.col("v")}
    got = temporal.trailing(rows, ["k"], "ts", 600, {}, block=1200, sums=sums)
    want = temporal.trailing(rows, ["k"], "ts", 600, {"n": F.count(F.lit(1)), "s": F.sum("v")}, block=1200)
    assert sorted(map(tuple, got.select("id", "n", "s").collect())) == sorted(map(tuple, want.select("id", "n", "s").collect()))
    # no frame is bound on both sides by a span: those are formed anew for every row
    assert "specifiedwindowframe(RangeFrame, -600000000" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_holding_totals_equal_pairs(spark):
    points = _dense(spark)
    spans = spark.range(200).selectExpr("id AS i", "id % 2 AS k", "timestamp_micros((id * 37) % 9000 * 1000000 + id % 3) AS s").selectExpr("*", "timestamp_micros(unix_micros(s) + (i * 31) % 4000 * 1000000 + i % 2) AS e")
    totals = {"n": (F.count(F.lit(1)), F.sum), "lo": (F.min("id"), F.min), "hi": (F.max("id"), F.max)}
    got = temporal.holding_totals(points, spans, ["k"], "ts", "s", "e", "i", totals, cell=60)
    pairs = points.withColumnRenamed("k", "pk").join(spans, F.expr("pk = k AND ts >= s AND ts < e"))
    want = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 150
