"""The whole service in one object: records, documents, corrections, the three methods, status.

All calls are set-wise: requests, corrections and changes are DataFrames. The state is a folder
of Parquet tables (snapshots for what changes, an append-only table for corrections) and saved
models, so any number of drivers can read it and a lost executor costs its tasks only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import columns as C
from runlens.functions.encoder import STATE, HashedTfIdf
from runlens.functions.vector import nearest
from runlens.operators import classify, forest, knowledge, tables
from runlens.sources import documents as D
from runlens.sources import records as R
from runlens.storage import durable, scratch

RECORD = "line_no bigint, timestamp string, service string, category string, snippet string, cause string"
DOCUMENT = "path string, service string, category string, content string"
OFFICIAL = "id bigint, text string, doc_path string, cause string, vector array<double>"
LEARNED = f"{knowledge.FEEDBACK_SCHEMA}, key bigint, vector array<double>, encoder bigint"
#: What answers call the two tiers, and the path of no answer.
TIERS = {knowledge.LEARNED: "LEARNED_MEMORY (Feedback)", knowledge.OFFICIAL: "OFFICIAL_KNOWLEDGE", knowledge.UNKNOWN: "UNKNOWN"}
NO_PATH = "N/A"


class Triage:
    """root: the folder of the state; docs_root: the folder that documents' paths start with.

    encoder turns a text column into an array<double> column (a pandas_udf around a sentence
    model, say); without one, texts are hashed TF-IDF vectors, whose state is fitted on records and
    documents when the index is built anew, and kept. Corrections tell by which state they were
    encoded; those of another one are encoded anew when they are searched.
    """

    def __init__(self, spark: SparkSession, root: str, docs_root: str, encoder: Callable[[Column], Column] | None = None):
        self.spark, self.root, self.docs_root, self.encoder = spark, root.rstrip("/"), docs_root.rstrip("/"), encoder
        self._records = tables.Snapshots(spark, f"{self.root}/records", RECORD)
        self._documents = tables.Snapshots(spark, f"{self.root}/documents", DOCUMENT)
        self._official = tables.Snapshots(spark, f"{self.root}/official", OFFICIAL)
        self._state = tables.Snapshots(spark, f"{self.root}/encoder", STATE)
        self._model = forest.load(f"{self.root}/models")

    # records

    def load_records(self, path: str) -> DataFrame:
        """Take over a records file by the tolerant grammar."""
        return self._records.replace(R.lenient(self.spark, path, strip_all=True).select(*self._names(RECORD)))

    def records(self) -> DataFrame:
        """The records with their position as id."""
        return D.listed(self._records.read(), "line_no", "id")

    def add_records(self, rows: DataFrame) -> DataFrame:
        """Append (service, category, snippet, cause[, timestamp]) rows; the time defaults to now. Rows that lack a field are an error."""
        if rows.filter(" OR ".join(f"{c} IS NULL" for c in ("service", "category", "snippet", "cause"))).limit(1).count():
            raise ValueError("service, category, snippet and cause are required")
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        given = F.col("timestamp") if "timestamp" in rows.columns else F.lit(None).cast("string")
        last = self._records.read().agg(F.coalesce(F.max("line_no"), F.lit(1))).first()[0]
        rows = durable(rows.withColumn("timestamp", F.coalesce(given, now)).withColumn("_row", F.monotonically_increasing_id()), "new-records")
        new = D.listed(rows, "_row", "_at").withColumn("line_no", F.col("_at") + 1 + last)  # by row: one time may be all rows'
        return self._records.append(new.select(*self._names(RECORD)))

    def update_records(self, changes: DataFrame) -> DataFrame:
        """Values by id; absent and null ones stay as they are. An id that is not there is an error."""
        rows = self._known(self.records(), changes)
        return self._records.replace(tables.update(rows, changes, "id").drop("id"))

    def delete_records(self, ids: DataFrame) -> DataFrame:
        rows = self._known(self.records(), ids)
        return self._records.replace(tables.delete(rows, ids, "id").drop("id"))

    # documents

    def load_documents(self) -> DataFrame:
        """Take over every Markdown file below docs_root."""
        return self._documents.replace(D.markdown(self.spark, self.docs_root).select(*self._names(DOCUMENT)))

    def documents(self) -> DataFrame:
        return D.listed(self._documents.read(), "path", "id").withColumn("size", C.size_text(F.col("content")))

    def document(self, path: str) -> DataFrame:
        return D.content_of(self._documents.read(), path, self.docs_root)

    def create_document(self, service: str, category: str, content: str) -> DataFrame:
        if not (service and category and content):
            raise ValueError("service, category and content are required")
        return self.put_document(f"{self.docs_root}/{service.lower()}/{category}.md", content)

    def put_document(self, path: str, content: str) -> DataFrame:
        """Create or replace a document; its path may not leave docs_root."""
        if ".." in path.replace("\\", "/").split("/") or not path.startswith(self.docs_root + "/"):
            raise ValueError(f"{path} is not below {self.docs_root}")
        row = self.spark.createDataFrame([(path, content)], "path string, content string")
        p = F.col("path")
        row = row.select("path", C.parent_name(p).alias("service"), C.stem(p).alias("category"), "content")
        return self._documents.replace(tables.upsert(self._documents.read(), row, "path"))

    def delete_documents(self, ids: DataFrame) -> DataFrame:
        rows = self._known(self.documents(), ids)
        return self._documents.replace(tables.delete(rows, ids, "id").select(*self._names(DOCUMENT)))

    # knowledge

    def refresh_index(self, mode: str = "if_empty") -> DataFrame:
        """Index the records: only if nothing is indexed yet, all anew ("rebuild"), or those that are new ("incremental")."""
        if mode not in ("if_empty", "rebuild", "incremental"):
            raise ValueError(mode)
        have = self._official.read()
        if mode == "if_empty" and not have.isEmpty():
            return have
        path = F.concat(F.lit(self.docs_root + "/"), F.lower(C.or_empty(F.col("service"))), F.lit("/"), C.or_empty(F.col("category")), F.lit(".md"))
        text = C.query_text(F.col("service"), F.col("category"), F.col("snippet"))
        rows = self._records.read().select(F.col("line_no").alias("id"), text.alias("text"), path.alias("doc_path"), "cause")
        new = tables.only_new(have, rows, "id") if mode == "incremental" else rows
        if self.encoder is None and (mode != "incremental" or self._state.read().isEmpty()):
            if mode == "incremental":  # an index from before there was a state
                return self.refresh_index("rebuild")
            texts = self._documents.read().select(F.concat(F.lit("d"), "path").alias("id"), F.col("content").alias("text"))
            texts = texts.unionByName(rows.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), "text"))
            self._state.replace(HashedTfIdf.fit(texts, "id", "text").state)
        made = self._encoded(new, "id", "text").select(*self._names(OFFICIAL))
        return self._official.append(made) if mode == "incremental" else self._official.replace(made)

    def corrections(self) -> DataFrame:
        """All corrections; an empty table before the first."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/learned")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(LEARNED).option("recursiveFileLookup", True).parquet(path.toString()) if there else self.spark.createDataFrame([], LEARNED)

    def teach(self, rows: DataFrame, part: str | None = None) -> None:
        """Append corrections (text, correct_doc_path[, ts]); the next search sees them. Rows that lack a field are left out.

        part: a name under which they replace what was taught by it before, so that a repeated call adds nothing.
        """
        given = F.col("ts").cast("string") if "ts" in rows.columns else F.lit(None).cast("string")
        good = knowledge.corrections(rows.withColumn("ts", F.coalesce(given, F.current_timestamp().cast("string")))).withColumn("key", F.xxhash64("id", "text", "correct_doc_path", "ts")).dropDuplicates(["key"])
        good = durable(good, "corrections")  # the time is part of the key and must not change
        made = self._encoded(good, "key", "text").withColumn("encoder", F.lit(self._version()).cast("bigint")).select(*self._names(LEARNED)).write
        made.mode("overwrite" if part else "append").parquet(f"{self.root}/learned/{part}" if part else f"{self.root}/learned")

    def train(self, with_cause: bool = True, **options) -> str:
        """Fit the forest on the records and keep it; the folder of the model."""
        cols = [F.col(c) for c in ("service", "category", "snippet", "cause")]
        rows = self._records.read().select(C.training_text(*cols, with_cause).alias("text"), F.concat(F.lit(self.docs_root + "/"), F.lower("service"), F.lit("/"), "category", F.lit(".md")).alias("doc_path"))
        with scratch(self.spark):
            made = durable(forest.hashed(rows, "text", options.get("features", forest.FEATURES)), "triage-hashed")
            self._model = forest.fit(made, "doc_path", **options)
        return forest.save(self._model, f"{self.root}/models")

    # answers

    def search(self, texts: DataFrame) -> DataFrame:
        """(qid, source, doc_path, confidence, root_cause) of the knowledge base for (qid bigint, text)."""
        learned, official = self._current(self.corrections()), self._official.read()
        vectors = durable(self._encoded(texts, "qid", "text").select("qid", "vector"), "triage-queries")
        hits = knowledge.two_tier(vectors, learned.select(F.col("key").alias("id"), "vector"), official.select("id", "vector"))
        told = learned.select(F.lit(knowledge.LEARNED).alias("source"), F.col("key").alias("id"), F.col("correct_doc_path").alias("doc_path"), F.lit(None).cast("string").alias("cause")).dropDuplicates(["id"])
        told = told.unionByName(official.select(F.lit(knowledge.OFFICIAL).alias("source"), "id", "doc_path", "cause"))
        label = F.coalesce(*[F.when(F.col("source") == k, v) for k, v in TIERS.items()])
        return hits.join(told, ["source", "id"], "left").select(
            "qid", label.alias("source"), F.coalesce("doc_path", F.lit(NO_PATH)).alias("doc_path"), "confidence", F.col("cause").alias("root_cause")
        )

    def semantic(self, texts: DataFrame, k: int = 1) -> DataFrame:
        """(qid, rank, doc_path, confidence): the k documents of the largest cosine, in per cent, for (qid bigint, text)."""
        docs = self.documents().select("id", "path", C.document_text(F.col("path"), F.col("content")).alias("text"))
        docs = durable(self._encoded(docs, "id", "text").select("id", "path", "vector"), "triage-documents")
        vectors = durable(self._encoded(texts, "qid", "text").select("qid", "vector"), "triage-queries")
        best = nearest(vectors, docs.select("id", "vector"), k, "cosine")
        return best.join(docs.select("id", F.col("path").alias("doc_path")), "id").select("qid", "rank", "doc_path", (F.col("value") * 100).alias("confidence"))

    def by_forest(self, texts: DataFrame) -> DataFrame:
        """(qid, doc_path, confidence) for (qid, text)."""
        if self._model is None:
            raise ValueError("no model has been trained")
        return forest.predict(self._model, forest.with_terms(texts.select("qid", "text"), "text")).select("qid", F.col("predicted").alias("doc_path"), "confidence")

    def available(self) -> tuple[str, ...]:
        """The methods that can answer."""
        knows = not self._official.read().isEmpty() or not self.corrections().isEmpty()
        have = (knows, not self._documents.read().isEmpty(), self._model is not None)
        return tuple(m for m, ok in zip(classify.METHODS, have, strict=True) if ok)

    def classify(self, requests: DataFrame) -> DataFrame:
        """An answer for each request (qid bigint, service, category, snippet, method).

        Columns: qid, method, status, error, doc_path, confidence, source, is_fallback, root_cause,
        warning. The other methods are asked only about requests whose document is missing.
        """
        live = self.available()
        told = durable(classify.dispatched(requests, live), "triage-requests")
        good = told.filter("status = 200").select("qid", "method", F.col("snippet").alias("snippet"), C.query_text(F.col("service"), F.col("category"), F.col("snippet")).alias("text"))
        first = durable(self._answers(good, {m: "snippet" if m == "SEMANTIC_SEARCH" else "text" for m in live}), "triage-answers")
        catalog = self._documents.read().select("path")
        missing = first.join(catalog, C.normal_path(F.col("doc_path")) == F.col("path"), "left_anti").select("qid")
        again = durable(good.join(missing, "qid", "left_semi").select("qid", F.col("method").alias("own"), "text"), "triage-missing")
        more = self._answers(again, {})
        for m in live:
            more = more.unionByName(self._answers(again.filter(F.col("own") != m).withColumn("method", F.lit(m)), {m: "text"}))
        solved = classify.resolved(first.select("qid", "method", "doc_path", "confidence"), durable(more, "triage-fallbacks").select("qid", "method", "doc_path", "confidence"), catalog)
        solved = classify.response(solved, catalog)
        out = told.select("qid", "method", "status", "error").join(solved.drop("method"), "qid", "left").join(first.select("qid", F.col("source").alias("_tier"), "root_cause"), "qid", "left")
        source = F.when(~F.col("is_fallback"), F.col("_tier")).otherwise(F.col("source"))
        return out.select("qid", "method", "status", "error", "doc_path", "confidence", source.alias("source"), "is_fallback", "root_cause", "warning")

    def batch(self, path: str) -> DataFrame:
        """The knowledge base's answers to a JSON array of records, by their snippets alone."""
        rows = durable(R.batch_inputs(self.spark, path).withColumn("_at", F.monotonically_increasing_id()), "triage-batch")
        rows = D.listed(rows, "_at", "qid").select("qid", F.col("Raw_Input_Snippet").alias("text"))
        found = self.search(rows)
        return rows.join(found, "qid").withColumn("shown", C.percent(F.col("confidence")))

    def status(self) -> DataFrame:
        """One row: healthy, model_status, vector_db_status, vector_db_records, learned_corrections."""
        return knowledge.counted(self._official.read(), self.corrections(), self.available(), classify.METHODS)

    def answer(self, bodies: DataFrame) -> DataFrame:
        """(qid, status, error, body): the JSON answers to JSON requests (qid bigint, body)."""
        out = self.classify(classify.decoded(bodies))
        return out.select("qid", "status", "error", F.when(F.col("status") == 200, classify.encoded(out)).alias("body"))

    # inner parts

    def _answers(self, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        """(qid, method, doc_path, confidence, source, root_cause) by each row's method, asked with the named text column."""
        none = F.lit(None).cast("string").alias("root_cause")
        every = self.spark.createDataFrame([], "qid bigint, source string, doc_path string, confidence double, root_cause string, method string")
        for method, column in columns.items():
            own = rows.filter(F.col("method") == method).select("qid", F.col(column).alias("text"))
            if method == "VECTOR_DB":
                part = self.search(own)
            elif method == "SEMANTIC_SEARCH":
                part = self.semantic(own).select("qid", F.lit(method).alias("source"), "doc_path", "confidence", none)
            else:
                part = self.by_forest(own).select("qid", F.lit(method).alias("source"), "doc_path", "confidence", none)
            every = every.unionByName(part.withColumn("method", F.lit(method)))
        return every

    def _version(self) -> int:
        """The number of the encoder's state; -1 for an encoder that was given."""
        if self.encoder is not None:
            return -1
        self._state.read()
        return self._state.number

    def _current(self, learned: DataFrame) -> DataFrame:
        """Corrections with vectors by the present state."""
        now = F.coalesce(F.col("encoder") == self._version(), F.lit(False))
        old = learned.filter(~now).dropDuplicates(["key"])
        return learned.filter(now).drop("encoder").unionByName(self._encoded(old.drop("vector"), "key", "text").drop("encoder"))

    def _encoded(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        if self.encoder is not None:
            return rows.withColumn("vector", self.encoder(F.col(text_col)).cast("array<double>"))
        state = self._state.read()
        model = HashedTfIdf(state) if self._state.number else HashedTfIdf.fit(rows.limit(0), id_col, text_col)
        return rows.join(model.vectors(rows, id_col, text_col), id_col)

    @staticmethod
    def _names(schema: str) -> list[str]:
        return [field.split()[0] for field in schema.split(", ")]

    @staticmethod
    def _known(rows: DataFrame, ids: DataFrame) -> DataFrame:
        rows = durable(rows, "triage-listed")
        if tables.only_new(rows, ids, "id").limit(1).count():
            raise KeyError("an id is not in the table")
        return rows
