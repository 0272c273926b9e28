"""The engine's queries over whole tables. Each has its DuckDB counterpart in plans/oracles.py under the same name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import cells
from runlens.functions import columns as C
from runlens.functions import text as T
from runlens.functions.postings import Postings, totals
from runlens.functions.vector import nearest
from runlens.operators import classify, knowledge, tables
from runlens.sources import documents as D
from runlens.sources.records import parsed, strict
from runlens.storage import durable, new_folder, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work on their texts, which a single small file should not leave to one core."""
    return spread(_docs(spark, sf_dir))


def _doc_path():
    return F.concat(F.lit("/data/services/"), "source", F.lit("/"), "lang", F.lit(".md"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def _requests(v: DataFrame) -> DataFrame:
    """The stated query set of a search: every row whose id is divisible by 20."""
    return v.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vector")


def _learned(v: DataFrame) -> DataFrame:
    """A correction near every row: its vector, the first component shifted by (id % 7) * 0.15."""
    shifted = F.transform("vector", lambda x, i: F.when(i == 0, x + (F.col("id") % 7) * F.lit(0.15)).otherwise(x))
    return v.select("id", shifted.alias("vector"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.coalesce("props", F.lit(""))
    snippet = F.when(F.col("event_id") % 2 == 0, F.concat(props, F.lit(", then "), "event_type")).otherwise(props)  # half of the lines have a comma more
    line = F.concat_ws(",", F.lit("2025-01-01T00:00:00Z"), F.col("user_id").cast("string"), "event_type", snippet, F.concat(F.lit("value "), F.coalesce(F.floor("value").cast("bigint").cast("string"), F.lit(""))))
    return _t(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query
def doc_catalog(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.col("source").alias("service"), F.col("lang").alias("category"), C.size_text(F.col("text")).alias("size"))
    return D.listed(rows, "doc_id", "position")


@query
def doc_content_lookup(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    url = pages.agg(F.min("url")).first()[0] or "/"
    found = D.content_of(pages.select(F.col("url").alias("path"), F.col("html").alias("content")), url, url.rsplit("/", 1)[0])
    return found.select(F.col("path").alias("url"), F.md5("content").alias("content_md5"), "size")


@query
def lenient_record_parse(spark, sf_dir):
    return parsed(_lines(spark, sf_dir)).filter("reason IS NULL").select("event_id", "service", "category", "snippet", "cause")


@query
def strict_vs_lenient_diff(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    path = new_folder(spark, "lines")
    lines.select(F.regexp_replace("line", "^[^,]*", F.col("event_id").cast("string")).alias("line")).write.text(path)  # the id in place of the time
    strictly = strict(spark, path, header=False).select(F.col("timestamp").cast("bigint").alias("event_id"), F.col("snippet").alias("strict_snippet"))
    rows = parsed(lines).filter("reason IS NULL").join(strictly, "event_id")
    return rows.filter(~F.col("strict_snippet").eqNullSafe(F.col("snippet"))).select("event_id", "snippet", "strict_snippet")


@query
def record_rejects(spark, sf_dir):
    lines = _texts(spark, sf_dir).select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    rows = parsed(lines).withColumn("reason", F.coalesce("reason", F.lit("ok")))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("reason") == "ok", F.length("snippet"))), F.lit(0)).cast("bigint").alias("snippet_chars"))


@query
def json_snippet_fields(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


@query
def target_path(spark, sf_dir):
    raw = C.target_path("/data/services", F.col("source"), F.col("lang"))
    return _docs(spark, sf_dir).select("doc_id", raw.alias("raw_path"), C.normal_path(raw).alias("path"))


@query
def path_parts(spark, sf_dir):
    url = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", C.parent_name(url).alias("parent"), C.base_name(url).alias("base"), C.stem(url).alias("stem"))


@query
def combined_features(spark, sf_dir):
    cols = [F.col("source"), F.col("lang"), F.col("text")]
    return _docs(spark, sf_dir).select(
        "doc_id", F.md5(C.query_text(*cols)).alias("query_md5"), F.md5(C.training_text(*cols, F.lit("cause"))).alias("training_md5"),
        F.md5(C.document_text(_doc_path(), F.col("text"))).alias("document_md5"),
    )


@query
def confidence_parse(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    label = F.when(F.col("label") < 3, "High").when(F.col("label") < 6, "Normal").otherwise("Other")
    number = F.when(F.col("label") == 9, F.lit(95.5))
    return e.select("vec_id", C.parsed_confidence(number, label).alias("confidence"))


@query
def confidence_band(spark, sf_dir):
    best = nearest(_requests(v := _vectors(spark, sf_dir)), v, 1, "cosine", but_itself=True)
    c = _hundredths(F.col("value"))
    return best.select(F.col("qid").alias("query_id"), c.alias("confidence"), C.band(c).alias("band"), C.percent(c).alias("shown"))


@query
def record_ids(spark, sf_dir):
    return D.listed(_t(spark, sf_dir, "events").select("event_id"), "event_id", "position").select("event_id", C.record_id(F.col("position") + 2).alias("id"))


@query
def token_counts(spark, sf_dir):
    return totals(_texts(spark, sf_dir), "doc_id", "text", pairs=False)


@query
def bigram_counts(spark, sf_dir):
    return totals(_texts(spark, sf_dir), "doc_id", "text", single=False).select("term", "n")


@query
def idf_table(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    return T.idf_of(totals(docs, "doc_id", "text"), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


def _matched(spark, sf_dir):
    """Items against documents: their terms go to the documents' blocks."""
    found = Postings(_texts(spark, sf_dir), "doc_id", "text")
    items = T.term_counts(_t(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "id")
    return found.best(durable(found.weighed(items), "item-weights")).select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "score")


@query
def tfidf_weights(spark, sf_dir):
    w = F.floor(F.col("w") * 1_000_000.0 + 0.5) / 1_000_000.0  # halves up, without a decimal number a row
    return Postings(_texts(spark, sf_dir), "doc_id", "text").weights().select(F.col("id").alias("doc_id"), "term", w.alias("w"))


@query
def tfidf_top1(spark, sf_dir):
    return _matched(spark, sf_dir)


@query
def hashed_encode(spark, sf_dir):
    return T.buckets_of(_texts(spark, sf_dir), "doc_id", "text")


@query
def cosine_top1(spark, sf_dir):
    best = nearest(_requests(v := _vectors(spark, sf_dir)), v, 1, "cosine", but_itself=True)
    return best.select(F.col("qid").alias("query_id"), F.col("id").alias("vec_id"), F.col("value").alias("score"))


@query
def cosine_topk(spark, sf_dir):
    best = nearest(_requests(v := _vectors(spark, sf_dir)), v, 5, "cosine", but_itself=True)
    return best.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("value").alias("score"))


@query
def l2_nearest(spark, sf_dir):
    best = nearest(_requests(v := _vectors(spark, sf_dir)), v, 1, "l2", but_itself=True)
    return best.select(F.col("qid").alias("query_id"), F.col("id").alias("vec_id"), F.col("value").alias("distance"))


@query
def ann_nearest(spark, sf_dir):
    """The 5 nearest rows by the index of cells; approximate, so without SQL: tests hold its recall against the exact search."""
    v = _vectors(spark, sf_dir)
    index = durable(cells.placed(v, found := cells.fit(v)), "cells")
    best = cells.search(_requests(v), index, found, 5, but_itself=True)
    return best.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("value").alias("distance"))


@query
def threshold_feedback(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    hits = nearest(_requests(v), _learned(v)).filter(F.col("value") < knowledge.NEAR)
    return hits.select(F.col("qid").alias("query_id"), F.col("id").alias("correction_id"), F.col("value").alias("distance"))


def _two_tier(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return knowledge.two_tier(_requests(v), _learned(v), v, but_itself=True)


@query
def two_tier_search(spark, sf_dir):
    return _two_tier(spark, sf_dir).select(F.col("qid").alias("query_id"), "source", F.col("id").alias("match_id"), "distance", "confidence")


@query
def knn_label_confusion(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    best = nearest(_requests(v), v, 1, "l2", but_itself=True).select("qid", "id")
    named = best.join(v.select("id", F.col("label").cast("bigint").alias("predicted")), "id").join(v.select(F.col("id").alias("qid"), F.col("label").cast("bigint").alias("actual")), "qid")
    return named.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query
def path_exists_semi(spark, sf_dir):
    return _t(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("quality").cast("bigint").alias("quality"))


@query
def path_missing_anti(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "source").join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def _hundredths(score):
    """A score of 6 digits in per cent with 2, halves up: in whole numbers, so that no engine's rounding matters."""
    return F.floor((F.round(score * 1_000_000).cast("bigint") + 50) / 100) / 100.0


def _catalog(docs: DataFrame) -> DataFrame:
    """Folders that have documents in few languages: so each rung of the ladder is taken by some row."""
    return docs.filter("(source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'de')) OR (source = 'src4' AND lang = 'en')").select(_doc_path().alias("path")).distinct()


@query
def best_match_doc(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    catalog = _catalog(docs)
    wanted = docs.select("source", "lang").distinct().select("*", F.col("source").alias("folder"), F.concat("lang", F.lit(".md")).alias("file"))
    return classify.best_match(wanted, catalog).select("source", "lang", "path")


@query
def first_available(spark, sf_dir):
    return _catalog(_docs(spark, sf_dir)).agg(F.min("path").alias("path"))


def _resolved(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    method = F.element_at(F.array(*[F.lit(m) for m in classify.METHODS]), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    answers = docs.select(F.col("doc_id").alias("qid"), method.alias("method"), C.target_path("/data/services", F.col("source"), F.col("lang")).alias("doc_path"), F.lit(75.0).alias("confidence"))
    # the other methods answer for some services only, with the English document of the service
    other = F.concat(F.lit("/data/services/"), "source", F.lit("/en.md"))
    some = docs.filter("source IN ('src2', 'src4', 'src7')")
    fallbacks = some.select(F.col("doc_id").alias("qid"), F.lit("SEMANTIC_SEARCH").alias("method"), other.alias("doc_path"), F.lit(61.5).alias("confidence"))
    fallbacks = fallbacks.unionByName(some.filter("source = 'src4'").select(F.col("doc_id").alias("qid"), F.lit("VECTOR_DB").alias("method"), other.alias("doc_path"), F.lit(95.0).alias("confidence")))
    forest = docs.filter("source = 'src3'").select(F.col("doc_id").alias("qid"), F.lit("RANDOM_FOREST").alias("method"), F.lit("/data/services/src3/de.md").alias("doc_path"), F.lit(44.0).alias("confidence"))
    return classify.resolved(answers, fallbacks.unionByName(forest), catalog := _catalog(docs)), catalog


@query
def fallback_ladder(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].select("qid", "doc_path", "confidence", "source", "is_fallback")


@query
def classify_response(spark, sf_dir):
    out = classify.response(*_resolved(spark, sf_dir))
    return out.groupBy("method", "source", "warning", C.band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query
def method_dispatch(spark, sf_dir):
    methods = F.array(*[F.lit(m) for m in (*classify.METHODS, "ORACLE")])
    items = _t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("snippet"), F.element_at(methods, (F.col("item_id") % 4 + 1).cast("int")).alias("method"))
    return classify.dispatched(items, available=classify.METHODS[:2]).select("item_id", "method", "status", "error")


def _changed(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", "event_type", "props")


@query
def dataset_insert(spark, sf_dir):
    e = _changed(spark, sf_dir)
    new = e.groupBy("event_type").agg(F.max("event_id").alias("m")).select((F.col("m") + 1_000_000_000).alias("event_id"), F.upper("event_type").alias("event_type"))
    return tables.insert(e, new)


@query
def dataset_update(spark, sf_dir):
    e = _changed(spark, sf_dir)
    new = e.filter("event_type = 'click'").select("event_id", F.lit("tap").alias("event_type"), F.when(F.col("event_id") % 2 == 0, F.lit("{}")).alias("props"))
    return tables.update(e, new, "event_id")


@query
def dataset_delete(spark, sf_dir):
    e = _changed(spark, sf_dir)
    left = tables.delete(e, e.filter("event_type = 'click'"), "event_id")
    return D.listed(left.select("event_id", "event_type"), "event_id", "position")


@query
def docs_upsert(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("content"))
    new = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.md5("html").alias("content"))
    return tables.upsert(d, new, "doc_id")


@query
def docs_delete(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "source")
    return D.listed(tables.delete(d, _t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), "doc_id"), "doc_id", "position")


@query
def index_incremental(spark, sf_dir):
    have = _t(spark, sf_dir, "labels").select("doc_id")
    return tables.only_new(have, _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("content")), "doc_id")


def _feedback(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select(
        "text", F.concat(F.lit("/data/"), "role", F.lit(".md")).alias("correct_doc_path"), F.format_string("%010d-%06d", "conv_id", "turn").alias("ts")
    )
    return knowledge.corrections(rows)


@query
def feedback_append(spark, sf_dir):
    return _feedback(spark, sf_dir).select("id", F.md5("text").alias("text_md5"), "correct_doc_path", "added_by", "ts")


@query
def feedback_latest(spark, sf_dir):
    return knowledge.latest(_feedback(spark, sf_dir)).select(F.md5("text").alias("text_md5"), "id", "correct_doc_path")


@query
def session_replay(spark, sf_dir):
    from runlens.shell import replay

    return replay(_t(spark, sf_dir, "conversations"))


@query
def batch_score(spark, sf_dir):
    named = _matched(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", _doc_path().alias("doc_path")), "doc_id")
    c = _hundredths(F.col("score"))
    return named.select("item_id", "doc_path", c.alias("confidence"), C.band(c).alias("band"))


@query
def status_counts(spark, sf_dir):
    documents = _docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("documents"))
    return knowledge.counted(_vectors(spark, sf_dir), _t(spark, sf_dir, "conversations"), classify.METHODS[:2], classify.METHODS).crossJoin(documents)  # one row each


@query
def rf_predict(spark, sf_dir):
    """Quality of every document by the forest, fitted on labelled ones but for a fourth that is held out; no SQL counterpart."""
    from runlens.operators import forest

    labels = _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    rows = durable(forest.hashed(_texts(spark, sf_dir).select("doc_id", "text").join(labels, "doc_id", "left"), "text"), "forest-hashed")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = forest.predict(forest.fit(rows.filter(~held & F.col("quality").isNotNull()), "quality", depth=8), rows)
    return out.select("doc_id", held.alias("held_out"), "quality", "predicted", F.round("confidence", 4).alias("confidence"))


@query
def request_decode(spark, sf_dir):
    fields = F.struct(F.col("source").alias("service"), F.col("lang").alias("error_category"), F.col("text").alias("raw_input_snippet"), F.when(F.col("doc_id") % 2 == 0, F.lit("SEMANTIC_SEARCH")).alias("method"))
    body = F.when(F.col("doc_id") % 50 == 7, F.lit("{broken")).otherwise(F.to_json(fields))
    told = classify.dispatched(classify.decoded(_docs(spark, sf_dir).select(F.col("doc_id").alias("qid"), body.alias("body"))))
    return told.select("qid", "service", "category", F.md5("snippet").alias("snippet_md5"), "method", "status", "error")


@query
def response_encode(spark, sf_dir):
    out = classify.response(*_resolved(spark, sf_dir))
    return out.select("qid", classify.encoded(out).alias("body"))


@query
def local_times(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", C.local_time(F.col("ts"), "+02:00").alias("shown"))


@query
def feedback_stream(spark, sf_dir):
    """Events taken as a stream in one go, counted per hour and type; the same as the batch counts."""
    from runlens.streaming.feedback import keep_counts, kept_counts, windowed_counts

    batch = _t(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be a file or a folder
    told = new_folder(spark, "windowed-counts")
    keep_counts(windowed_counts(stream), told, new_folder(spark, "windowed-checkpoint")).awaitTermination()
    return kept_counts(spark, told).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query
def corrections_stream(spark, sf_dir):
    """The corrections of feedback_append, taken as a stream of two arrivals of files."""
    from runlens.streaming.feedback import feedback_stream as take
    from runlens.streaming.feedback import stored

    source, sink, checkpoint = (new_folder(spark, f"corrections-{n}") for n in ("source", "sink", "checkpoint"))
    rows = _t(spark, sf_dir, "conversations").select("text", F.concat(F.lit("/data/"), "role", F.lit(".md")).alias("correct_doc_path"), F.format_string("%010d-%06d", "conv_id", "turn").alias("ts"), "conv_id")
    for half in (0, 1):
        rows.filter(F.pmod("conv_id", F.lit(2)) == half).drop("conv_id").write.mode("append").json(source)
        take(spark, source, sink, checkpoint).awaitTermination()
    return stored(spark, sink).select("id", F.md5("text").alias("text_md5"), "correct_doc_path", "added_by", "ts")


@query
def normal_paths(spark, sf_dir):
    """Paths with steps back and to the same folder."""
    raw = F.concat(F.lit("/data/services/services/./"), "source", F.lit("/x//../"), "lang", F.lit("/y/../../"), F.col("doc_id").cast("string"), F.lit(".md"))
    return _docs(spark, sf_dir).select("doc_id", C.normal_path(raw).alias("path"), C.normal_path(F.concat(F.lit("/../"), "lang", F.lit("/.."))).alias("top"), C.normal_path(F.concat(F.lit("../"), "lang", F.lit("/../.."))).alias("out"))
