"""Queries in time and over versions of a table, with their DuckDB SQL; each runs through its operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions.cell_files import CellFiles
from runlens.functions.encoder import HashedTfIdf, counted
from runlens.functions import columns as C
from runlens.functions import snippets
from runlens.operators import classify, differences, knowledge, levels, temporal
from runlens.plans.oracles import SQL
from runlens.plans.queries import _docs, _requests, _t, _texts, _vectors, query
from runlens.storage import durable, new_folder
from runlens.streaming.sessions import SessionStream

DAY = 86_400


def _cents(value: str = "value"):
    return F.round(F.col(value) * 100).cast("bigint")


@query
def asof_correction(spark, sf_dir):
    """Each event with the latest large one of its type: a few types, each split by time."""
    events = _t(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    large = events.filter("value > 30").withColumnsRenamed({"event_id": "correction_id", "value": "correction_value"})
    return temporal.as_of(events.drop("value"), large, ["event_type"], "ts", ["correction_id", "correction_value"], block=DAY // 4)


SQL["asof_correction"] = """
SELECT e.event_id, e.event_type, e.ts, c.correction_id, c.correction_value FROM events e
ASOF LEFT JOIN (SELECT event_type, ts, max(event_id) AS correction_id, arg_max(value, event_id) AS correction_value FROM events WHERE value > 30 GROUP BY ALL) c
ON e.event_type = c.event_type AND e.ts >= c.ts
"""


@query
def interval_incidents(spark, sf_dir):
    """Events within an incident of their type: a large error opens one for all types, for as many hours as its value says."""
    events = _t(spark, sf_dir, "events")
    end = F.timestamp_micros(temporal.micros("ts") + _cents() * 36_000_000)
    errors = events.filter("event_type = 'error' AND value > 80").select(F.col("event_id").alias("incident_id"), F.pmod("user_id", F.lit(8)).alias("service"), F.col("ts").cast("timestamp").alias("start"), end.alias("end"))
    points = events.select("event_id", F.pmod("user_id", F.lit(8)).alias("service"), F.col("ts").cast("timestamp").alias("ts"))
    totals = {"n": (F.count(F.lit(1)), F.sum), "first_event": (F.min("event_id"), F.min), "last_event": (F.max("event_id"), F.max)}
    return temporal.holding_totals(points, errors, ["service"], "ts", "start", "end", "incident_id", totals, cell=60)


SQL["interval_incidents"] = """
WITH i AS (SELECT event_id AS incident_id, user_id % 8 AS service, ts AS s, ts + to_microseconds(round(value * 100)::BIGINT * 36000000) AS e FROM events WHERE event_type = 'error' AND value > 80)
SELECT incident_id, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event
FROM events JOIN i ON user_id % 8 = service AND ts >= s AND ts < e GROUP BY incident_id
"""


@query
def trailing_error_rate(spark, sf_dir):
    """Events and errors of a service in the hour up to each event."""
    events = _t(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.pmod("user_id", F.lit(8)).alias("service"))
    sums = {"n": F.lit(1), "errors": (F.col("event_type") == "error").cast("bigint")}
    told = temporal.trailing(events, ["service"], "ts", 3600, {}, block=DAY // 4, sums=sums)
    return told.select("event_id", "service", "n", "errors", F.round(F.col("errors") / F.col("n"), 6).alias("rate"))


SQL["trailing_error_rate"] = """
SELECT event_id, user_id % 8 AS service, count(*) OVER w AS n, (sum((event_type = 'error')::BIGINT) OVER w)::BIGINT AS errors,
       round((sum((event_type = 'error')::BIGINT) OVER w) / count(*) OVER w, 6) AS rate
FROM events WINDOW w AS (PARTITION BY user_id % 8 ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)
"""

#: Of session_windows: the parts that arrive one after the other, a session's gap, and the delay that is waited for late rows, in seconds.
ARRIVALS, GAP, DELAY = 4, DAY // 2, DAY


@query
def session_windows(spark, sf_dir):
    """Sessions of users from events that arrive in parts, a tenth of them one part too late; late rows by themselves."""
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), _cents().alias("cents"))
    most = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    part = F.least(F.floor(F.col("event_id") * ARRIVALS / most) + (F.col("event_id") % 10 == 7).cast("int"), F.lit(ARRIVALS - 1))
    parts = durable(events.withColumn("part", part), "session-parts")
    source, state = new_folder(spark, "session-source"), new_folder(spark, "session-state")
    sessions = SessionStream(spark, state, events.schema, ["user_id"], "ts", GAP, DELAY, ["cents"])
    parts.limit(0).drop("part").write.parquet(source)
    for i in range(ARRIVALS):
        parts.filter(F.col("part") == i).drop("part").write.mode("append").parquet(source)
        sessions.run(spark.readStream.schema(events.schema).parquet(source), f"{state}/checkpoint").awaitTermination()
    told = sessions.closed().unionByName(sessions.open()).withColumn("kind", F.lit("session"))
    late = sessions.late().select("user_id", F.col("ts").alias("start"), F.lit(None).cast("timestamp").alias("end"), F.lit(1).cast("bigint").alias("n"), "cents", F.lit("late").alias("kind"))
    return told.unionByName(late).select("kind", "user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n", "cents")


SQL["session_windows"] = f"""
WITH t AS (SELECT *, least(event_id * {ARRIVALS} // (SELECT max(event_id) + 1 FROM events) + (event_id % 10 = 7)::INT, {ARRIVALS - 1}) AS part, round(value * 100)::BIGINT AS cents FROM events),
m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {DELAY} SECOND AS mark FROM t GROUP BY part),
d AS (SELECT t.*, coalesce(ts < mark, false) AS late FROM t JOIN m USING (part)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL {GAP} SECOND, true))::INT AS new FROM d WHERE NOT late))
SELECT 'session' AS kind, user_id, min(ts) AS start, max(ts) + INTERVAL {GAP} SECOND AS "end", count(*) AS n, sum(cents)::BIGINT AS cents FROM g GROUP BY user_id, s
UNION ALL SELECT 'late', user_id, ts, NULL, 1, cents FROM d WHERE late
"""


def _dims(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(8)).alias("service"), F.col("event_type").alias("category"), F.hour("ts").cast("bigint").alias("hour"), _cents().alias("cents"), "event_id")


@query
def cube_levels(spark, sf_dir):
    """All levels of service, category and hour: those of one half of the events are kept and the others' added."""
    rows, dims = _dims(spark, sf_dir), ["service", "category", "hour"]
    half = [levels.levels(rows.filter(F.col("event_id") % 2 == i), dims, ["cents"]) for i in (0, 1)]
    return levels.added(durable(half[0], "levels"), half[1], dims, ["cents"])


SQL["cube_levels"] = """
SELECT service, category, hour, grouping_id(service, category, hour)::BIGINT AS level, count(*) AS n, sum(cents)::BIGINT AS cents
FROM (SELECT user_id % 8 AS service, event_type AS category, hour(ts) AS hour, round(value * 100)::BIGINT AS cents FROM events) GROUP BY CUBE (service, category, hour)
"""


@query
def sketch_bounds(spark, sf_dir):
    """Per day the exact users and rows, and whether sketches kept per hour and merged come near: users within 3 %, the median's rank within 2 %."""
    rows = _t(spark, sf_dir, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.hour("ts").alias("hour"), "user_id", "value")
    kept = durable(levels.sketched(rows, ["day", "hour"], "user_id", "value"), "sketches")
    told = levels.told(levels.merged(kept, ["day"]), {"median": 0.5}).withColumnsRenamed({"who": "about", "n": "rows"})
    met = rows.join(told, "day").groupBy("day", "rows", "about").agg(
        F.countDistinct("user_id").alias("users"), F.avg((F.col("value") < F.col("median")).cast("int")).alias("below"), F.avg((F.col("value") <= F.col("median")).cast("int")).alias("upto")
    )
    near = F.abs(F.col("about") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 0.03)
    return met.select("day", F.col("rows").alias("n"), "users", near.alias("users_near"), ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_near"))


SQL["sketch_bounds"] = "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near FROM events GROUP BY 1"


def _versions(spark, sf_dir):
    """Two versions of a table of events: rows that went, came, changed, and that are there twice."""
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", "props")
    tenth = F.pmod("event_id", F.lit(10))
    new = e.filter(tenth != 1).withColumn("event_type", F.when(tenth == 2, F.upper("event_type")).otherwise(F.col("event_type")))
    return e.filter(tenth != 0).unionByName(e.filter(tenth == 4)), new.unionByName(new.filter(tenth.isin(3, 4)))


_OLD = "o AS (SELECT event_id, event_type, props FROM events WHERE event_id % 10 != 0 UNION ALL SELECT event_id, event_type, props FROM events WHERE event_id % 10 = 4)"
_NEW = """v AS (SELECT event_id, CASE WHEN event_id % 10 = 2 THEN upper(event_type) ELSE event_type END AS event_type, props FROM events WHERE event_id % 10 != 1),
n AS (SELECT * FROM v UNION ALL SELECT * FROM v WHERE event_id % 10 IN (3, 4))"""


@query
def snapshot_difference(spark, sf_dir):
    return differences.difference(*_versions(spark, sf_dir), "event_id")


SQL["snapshot_difference"] = f"""
WITH {_OLD}, {_NEW}, d AS (SELECT event_id, event_type, props, sum(c)::BIGINT AS change FROM (SELECT *, -1 AS c FROM o UNION ALL SELECT *, 1 FROM n) GROUP BY 1, 2, 3 HAVING sum(c) != 0)
SELECT *, CASE WHEN max(change) OVER w > 0 AND min(change) OVER w < 0 THEN 'changed' WHEN change > 0 THEN 'inserted' ELSE 'deleted' END AS kind FROM d WINDOW w AS (PARTITION BY event_id)
"""


@query
def snapshot_applied(spark, sf_dir):
    """The old version after the difference: the new one, copies of rows included."""
    old, new = _versions(spark, sf_dir)
    return differences.applied(old, durable(differences.difference(old, new, "event_id"), "difference"))


SQL["snapshot_applied"] = f"WITH {_NEW} SELECT * FROM n"

SQL["corrections_stream"] = SQL["feedback_append"]

SQL["normal_paths"] = "SELECT doc_id, '/data/services/' || source || '/' || doc_id || '.md' AS path, '/' AS top, '../..' AS out FROM documents"


@query
def encoded_vectors(spark, sf_dir):
    """Documents by the encoder that is fitted on them: the slots that are not 0."""
    docs = durable(counted(_texts(spark, sf_dir).select("doc_id", "text"), "doc_id", "text"), "slots")
    return HashedTfIdf.fit(docs, "doc_id", "text").entries(docs, "doc_id", "text").select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("w", 6).alias("w"))


@query
def two_tier_texts(spark, sf_dir):
    """Items as requests to the knowledge base, by texts: documents are official, a third of the items was taught with a word more."""
    docs, items = _texts(spark, sf_dir).select("doc_id", "text"), _t(spark, sf_dir, "benchmark").select("item_id", "text")
    docs = durable(counted(docs, "doc_id", "text"), "slots")
    model = HashedTfIdf(durable(HashedTfIdf.fit(docs, "doc_id", "text").state, "encoder"))
    taught = items.filter("item_id % 3 = 0").select("item_id", F.concat("text", F.lit(" again")).alias("text"))
    asked, learned = (durable(model.vectors(rows, "item_id", "text").withColumnRenamed("item_id", name), "vectors") for rows, name in ((items, "qid"), (taught, "id")))
    told = knowledge.two_tier(asked, learned, model.vectors(docs, "doc_id", "text").withColumnRenamed("doc_id", "id"))
    return told.select(F.col("qid").alias("item_id"), "source", F.col("id").alias("match_id"), "distance", "confidence")


_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"
_ENCODED = f"""t AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark UNION ALL SELECT 'l', item_id, text || ' again' FROM benchmark WHERE item_id % 3 = 0),
h AS (SELECT k, id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS bucket, CASE WHEN ('0x' || substr(md5(w), 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS s
      FROM (SELECT k, id, unnest({_TOKENS}) AS w FROM t)),
b AS (SELECT k, id, bucket, sum(s) AS s FROM h GROUP BY ALL),
f AS (SELECT bucket, count(*) AS df FROM b WHERE k = 'd' GROUP BY bucket),
r AS (SELECT k, id, bucket, s * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + coalesce(df, 0))) + 1) AS w FROM b LEFT JOIN f USING (bucket) WHERE s != 0),
e AS (SELECT k, id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY k, id)) AS w FROM r)"""

SQL["encoded_vectors"] = f"WITH {_ENCODED} SELECT id AS doc_id, bucket, round(w, 6) AS w FROM e WHERE k = 'd'"

SQL["two_tier_texts"] = f"""
WITH {_ENCODED}, m AS (SELECT q.id AS qid, x.k, x.id, sum(q.w * x.w) AS dot FROM e q JOIN e x ON q.k = 'q' AND x.k != 'q' AND q.bucket = x.bucket GROUP BY ALL),
z AS (SELECT k, id, count(bucket) > 0 AS one FROM t LEFT JOIN e USING (k, id) GROUP BY ALL),
d AS (SELECT q.id AS qid, x.k, x.id, round(q.one::INT + x.one::INT - 2 * coalesce(dot, 0), 6) + 0.0 AS d FROM z q JOIN z x ON q.k = 'q' AND x.k != 'q' LEFT JOIN m ON m.qid = q.id AND m.k = x.k AND m.id = x.id),
n AS (SELECT qid, k, d, id FROM d QUALIFY row_number() OVER (PARTITION BY qid, k ORDER BY d, id) = 1)
SELECT o.qid AS item_id, CASE WHEN l.d < 0.4 THEN 'LEARNED' ELSE 'OFFICIAL' END AS source, CASE WHEN l.d < 0.4 THEN l.id ELSE o.id END AS match_id,
       CASE WHEN l.d < 0.4 THEN l.d ELSE o.d END AS distance, CASE WHEN l.d < 0.4 THEN 95.0 ELSE 75.0 END AS confidence
FROM n o LEFT JOIN n l ON l.qid = o.qid AND l.k = 'l' WHERE o.k = 'd'
"""


@query
def ann_file_index(spark, sf_dir):
    """The 5 nearest rows by the index in files; approximate, so without SQL: tests hold its recall against the exact search."""
    v = _vectors(spark, sf_dir)
    best = CellFiles.write(v, new_folder(spark, "cell-files")).search(_requests(v), 5, but_itself=True)
    return best.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("value").alias("distance"))


@query
def snippet_fields(spark, sf_dir):
    """Fields of snippets as JSON, as pairs in brackets, and of pairs that break off."""
    k = F.get_json_object("props", "$.k")
    cut = F.concat(F.lit("k="), k, F.lit("; type: "), "event_type", F.lit(", ;"))
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("{k: "), k, F.lit(", type: \""), "event_type", F.lit("\"}"))).otherwise(cut)
    p = _t(spark, sf_dir, "events").select("event_id", snippets.parsed(text).alias("p"))
    return p.select("event_id", "p.kind", F.col("p.fields")["k"]["type"].alias("k_type"), F.col("p.fields")["k"]["value"].alias("k"), F.col("p.fields")["type"]["value"].alias("type"), F.col("p.fault").cast("bigint").alias("fault"))


SQL["snippet_fields"] = """
WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'json' ELSE 'pairs' END AS kind, 'number' AS k_type, k, CASE WHEN event_id % 3 > 0 THEN event_type END AS type,
       CASE WHEN event_id % 3 = 2 THEN 2 + length(k) + 8 + length(event_type) + 1 ELSE 0 END AS fault FROM e
"""


@query
def corrections_required(spark, sf_dir):
    """Corrections of which some lack a text or a path: those are left out."""
    c, third = _t(spark, sf_dir, "conversations"), F.pmod("conv_id", F.lit(3))
    rows = c.select(F.when(third != 0, F.col("text")).otherwise("").alias("text"), F.when(third != 1, F.concat(F.lit("/data/"), "role", F.lit(".md"))).alias("correct_doc_path"), F.format_string("%010d-%06d", "conv_id", "turn").alias("ts"))
    return knowledge.corrections(rows).select(F.md5("text").alias("text_md5"), "correct_doc_path", "added_by", "ts")


SQL["corrections_required"] = "SELECT md5(text) AS text_md5, '/data/' || role || '.md' AS correct_doc_path, 'user' AS added_by, printf('%010d-%06d', conv_id, turn) AS ts FROM conversations WHERE conv_id % 3 = 2 AND text != ''"


@query
def ladder_not_found(spark, sf_dir):
    """Answers where no document is there at all: path and confidence stay, with a warning."""
    docs = _docs(spark, sf_dir)
    answers = docs.select(F.col("doc_id").alias("qid"), F.lit("VECTOR_DB").alias("method"), C.target_path("/data/services", F.col("source"), F.col("lang")).alias("doc_path"), F.lit(75.0).alias("confidence"))
    none = docs.select(F.lit("").alias("path")).limit(0)
    out = classify.response(classify.resolved(answers, answers.limit(0), none), none)
    return out.select("qid", "doc_path", "confidence", "is_fallback", F.col("warning").isNotNull().alias("warned"))


SQL["ladder_not_found"] = "SELECT doc_id AS qid, '/data/services/' || lower(source) || '/' || lang || '.md' AS doc_path, 75.0::DOUBLE AS confidence, false AS is_fallback, true AS warned FROM documents"
