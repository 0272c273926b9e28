"""From predictions to answers: dispatch by method, verification, and the ladder of fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import columns as C

METHODS = ("VECTOR_DB", "SEMANTIC_SEARCH", "RANDOM_FOREST")


def dispatched(requests: DataFrame, available=METHODS) -> DataFrame:
    """requests with status and error: 400 for an empty snippet or an unknown method, 503 for one that is not there."""
    method = F.coalesce("method", F.lit(METHODS[0]))
    empty = C.stripped(C.or_empty(F.col("snippet"))) == ""
    status = F.when(empty, 400).when(~method.isin(*METHODS), 400).when(~method.isin(*available), 503).otherwise(200)
    error = F.when(empty, "empty snippet").when(~method.isin(*METHODS), "unknown method").when(~method.isin(*available), "method unavailable")
    return requests.withColumn("method", method).withColumn("status", status.cast("bigint")).withColumn("error", error)


#: Field names of requests and answers.
REQUEST = "service string, error_category string, raw_input_snippet string, method string"
ANSWER = ("doc_path", "confidence", "source", "root_cause", "warning")


def decoded(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """(service, category, snippet, method) from JSON bodies; absent fields are empty, the method its default.

    A body that is not a JSON object gives an empty snippet, which dispatched() refuses.
    """
    fields = F.from_json(F.col(body_col), REQUEST)
    return bodies.select(
        *[c for c in bodies.columns if c != body_col],
        C.or_empty(fields["service"]).alias("service"), C.or_empty(fields["error_category"]).alias("category"),
        C.or_empty(fields["raw_input_snippet"]).alias("snippet"), F.coalesce(fields["method"], F.lit(METHODS[0])).alias("method"),
    )


def encoded(answers: DataFrame) -> Column:
    """The JSON text of an answer's fields; an empty cause and an absent warning are left out."""
    fields = [F.nullif(F.col(c), F.lit("")).alias(c) if c == "root_cause" else F.col(c) for c in ANSWER if c in answers.columns]
    return F.to_json(F.struct(*fields))


def matches(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The least path of each folder and of each file name: two small tables instead of pairs."""
    named = catalog.select("path", C.parent_name(F.col("path")).alias("folder"), C.base_name(F.col("path")).alias("file"))
    return named.groupBy("folder").agg(F.min("path").alias("_by_folder")), named.groupBy("file").agg(F.min("path").alias("_by_file"))


def best_match(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows (folder, file, ...) with `path`: the first document in path order that shares folder or file, or null."""
    folder, file = matches(catalog)
    return rows.join(folder, "folder", "left").join(file, "file", "left").withColumn("path", F.least("_by_folder", "_by_file")).drop("_by_folder", "_by_file")


def resolved(answers: DataFrame, fallbacks: DataFrame, catalog: DataFrame) -> DataFrame:
    """answers (qid, method, doc_path, confidence) checked against the paths that exist.

    fallbacks: (qid, method, doc_path, confidence), the other methods' predictions; they are
    tried in the order of METHODS, except the answer's own. Then the first document in path
    order that shares the folder or the file name, then the first document of all, then the
    path as it was. Only answers that fail a rung go on to the next.
    """
    answers = answers.withColumn("doc_path", C.normal_path(F.col("doc_path")))
    paths = catalog.select(F.col("path").alias("_path")).distinct()
    hit = answers.join(paths, F.col("doc_path") == F.col("_path"), "left")
    direct = hit.filter("_path IS NOT NULL").select("*", F.col("method").alias("source"), F.lit(False).alias("is_fallback")).drop("_path")
    open_ = hit.filter("_path IS NULL").drop("_path")

    rank = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("fm")), F.lit(0))
    others = fallbacks.select(F.col("qid"), F.col("method").alias("fm"), C.normal_path(F.col("doc_path")).alias("fp"), F.col("confidence").alias("fc"))
    tried = others.join(open_.select("qid", "method"), "qid").filter("fm <> method").join(paths, F.col("fp") == F.col("_path"), "left_semi")
    best = tried.groupBy("qid").agg(F.min(F.struct(rank.alias("r"), "fp", "fc", "fm")).alias("b"))

    first = catalog.agg(F.min("path").alias("_first"))
    rest = open_.join(best, "qid", "left").withColumn("folder", C.parent_name(F.col("doc_path"))).withColumn("file", C.base_name(F.col("doc_path")))
    rest = best_match(rest, catalog).withColumnRenamed("path", "_match").crossJoin(F.broadcast(first))  # one row
    match = F.col("_match")
    path = F.coalesce("b.fp", match, "_first", "doc_path")
    confidence = F.when(F.col("b").isNotNull(), F.col("b.fc")).when(match.isNotNull(), F.lit(C.BEST_MATCH)).when(F.col("_first").isNotNull(), F.lit(C.FIRST_AVAILABLE)).otherwise(F.col("confidence"))
    source = (
        F.when(F.col("b").isNotNull(), F.concat("b.fm", F.lit(" (Fallback)")))
        .when(match.isNotNull(), F.concat("method", F.lit(" (Best Match)")))
        .when(F.col("_first").isNotNull(), F.concat("method", F.lit(" (Fallback - First Available)")))
        .otherwise(F.col("method"))
    )
    fallen = F.col("b").isNotNull() | match.isNotNull() | F.col("_first").isNotNull()
    kept = [c for c in answers.columns if c not in ("doc_path", "confidence")]
    lower = rest.select(*kept, path.alias("doc_path"), confidence.alias("confidence"), source.alias("source"), fallen.alias("is_fallback"))
    return direct.select(*lower.columns).unionByName(lower)


def response(answers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolved answers with the warning that goes with them."""
    paths = catalog.select(F.col("path").alias("_path")).distinct()
    joined = answers.join(paths, F.col("doc_path") == F.col("_path"), "left")
    warning = F.when(F.col("is_fallback"), "The predicted document was missing; a fallback was used.").when(F.col("_path").isNull(), "The predicted document is missing and nothing replaces it.")
    return joined.withColumn("warning", warning).drop("_path")
