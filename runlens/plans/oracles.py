"""DuckDB SQL of the queries in plans/queries.py, written independently of them."""

TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"
PAIRS = "list_concat(w, list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda x: x[1] || ' ' || x[2]))"
PATH = "'/data/services/' || source || '/' || lang || '.md'"
LINE = "concat_ws(',', '2025-01-01T00:00:00Z', user_id::VARCHAR, event_type, coalesce(props, '') || CASE WHEN event_id % 2 = 0 THEN ', then ' || event_type ELSE '' END, 'value ' || coalesce(floor(value)::BIGINT::VARCHAR, ''))"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
PARSED = rf"""
l AS (SELECT *, string_split(line, ',') AS p FROM src),
r AS (SELECT *, CASE WHEN len(p) >= 4 THEN array_to_string(p[4:], ',') END AS rest,
      CASE WHEN trim(line, E' \t\n\r\f\v') = '' THEN 'blank' WHEN len(p) < 4 THEN 'malformed' WHEN len(p) < 5 THEN 'missing_cause' END AS reason FROM l),
f AS (SELECT *, {STRIP.format("array_to_string(p[4:len(p) - 1], ',')")} AS snippet, {STRIP.format("p[len(p)]")} AS cause FROM r)"""
V = """
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label FROM embeddings),
q AS (SELECT id AS qid, vector AS qv FROM v WHERE id % 20 = 0)"""
COS = V + """,
s AS (SELECT qid, id, round(list_cosine_similarity(qv, vector), 6) AS score FROM q JOIN v ON id <> qid),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)"""
L2 = V + """,
s AS (SELECT qid, id, round(list_sum(list_transform(list_zip(qv, vector), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS d FROM q JOIN v ON id <> qid),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, id) = 1),
lv AS (SELECT id, list_concat([vector[1] + (id % 7) * 0.15::DOUBLE], vector[2:]) AS vector FROM v),
ls AS (SELECT qid, id, round(list_sum(list_transform(list_zip(qv, vector), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS d FROM q JOIN lv ON true),
f AS (SELECT * FROM (SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, id) = 1) WHERE d < 0.4)"""
TF = f"""
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({PAIRS}) AS term FROM (SELECT doc_id, {TOK} AS w FROM documents)) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1 AS idf FROM df),
raw AS (SELECT doc_id, term, tf * idf AS r FROM tf JOIN idf USING (term)),
w AS (SELECT doc_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS w FROM raw)"""
TOP = TF + f""",
qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({PAIRS}) AS term FROM (SELECT item_id, {TOK} AS w FROM benchmark)) GROUP BY ALL),
qr AS (SELECT item_id, term, tf * idf AS r FROM qt JOIN idf USING (term)),
qw AS (SELECT item_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY item_id)) AS q FROM qr),
sc AS (SELECT item_id, doc_id, round(sum(q * w), 6) AS score FROM qw JOIN w USING (term) GROUP BY ALL),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) = 1)"""
CAT = f"cat AS (SELECT DISTINCT {PATH} AS path, source AS folder, lang || '.md' AS file FROM documents WHERE (source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'de')) OR (source = 'src4' AND lang = 'en'))"
LADDER = f"""
{CAT},
a AS (SELECT doc_id AS qid, ['VECTOR_DB', 'SEMANTIC_SEARCH', 'RANDOM_FOREST'][(doc_id % 3 + 1)::INT] AS method, source, lang, '/data/services/' || lower(source) || '/' || lang || '.md' AS p FROM documents),
x AS (SELECT a.*, EXISTS (SELECT 1 FROM cat WHERE path = p) AS direct,
      CASE WHEN source = 'src4' AND method <> 'VECTOR_DB' AND EXISTS (SELECT 1 FROM cat WHERE path = '/data/services/src4/en.md') THEN 'VECTOR_DB'
           WHEN source IN ('src2', 'src4', 'src7') AND method <> 'SEMANTIC_SEARCH' AND EXISTS (SELECT 1 FROM cat WHERE path = '/data/services/' || source || '/en.md') THEN 'SEMANTIC_SEARCH'
           WHEN source = 'src3' AND method <> 'RANDOM_FOREST' AND EXISTS (SELECT 1 FROM cat WHERE path = '/data/services/src3/de.md') THEN 'RANDOM_FOREST' END AS fm,
      (SELECT min(path) FROM cat WHERE folder = source OR file = lang || '.md') AS best, (SELECT min(path) FROM cat) AS first FROM a),
y AS (SELECT qid, method,
      CASE WHEN direct THEN p WHEN fm = 'RANDOM_FOREST' THEN '/data/services/src3/de.md' WHEN fm IS NOT NULL THEN '/data/services/' || source || '/en.md' ELSE coalesce(best, first, p) END AS doc_path,
      CASE WHEN direct THEN 75.0 WHEN fm = 'VECTOR_DB' THEN 95.0 WHEN fm = 'RANDOM_FOREST' THEN 44.0 WHEN fm IS NOT NULL THEN 61.5 WHEN best IS NOT NULL THEN 50.0 WHEN first IS NOT NULL THEN 30.0 ELSE 75.0 END::DOUBLE AS confidence,
      CASE WHEN direct THEN method WHEN fm IS NOT NULL THEN fm || ' (Fallback)' WHEN best IS NOT NULL THEN method || ' (Best Match)'
           WHEN first IS NOT NULL THEN method || ' (Fallback - First Available)' ELSE method END AS source,
      NOT direct AND (fm IS NOT NULL OR best IS NOT NULL OR first IS NOT NULL) AS is_fallback FROM x)"""
FB = """
fb AS (SELECT text, '/data/' || role || '.md' AS correct_doc_path, printf('%010d-%06d', conv_id, turn) AS ts FROM conversations WHERE coalesce(text, '') <> '' AND role IS NOT NULL AND role <> ''),
c AS (SELECT 'fix_' || substr(md5(concat_ws(chr(31), text, correct_doc_path, ts)), 1, 8) AS id, * FROM fb)"""

SQL = {
    "doc_catalog": "SELECT doc_id, source AS service, lang AS category, length(coalesce(text, ''))::VARCHAR || ' chars' AS size, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents",
    "doc_content_lookup": "SELECT url, md5(html) AS content_md5, length(html)::BIGINT AS size FROM pages WHERE url = (SELECT min(url) FROM pages)",
    "lenient_record_parse": f"WITH src AS (SELECT event_id, {LINE} AS line FROM events), {PARSED} SELECT event_id, p[2] AS service, p[3] AS category, snippet, cause FROM f WHERE reason IS NULL",
    "strict_vs_lenient_diff": f"WITH src AS (SELECT event_id, {LINE} AS line FROM events), {PARSED} SELECT event_id, snippet, p[4] AS strict_snippet FROM f WHERE reason IS NULL AND p[4] IS DISTINCT FROM snippet",
    "record_rejects": f"WITH src AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), {PARSED} SELECT coalesce(reason, 'ok') AS reason, count(*) AS n, coalesce(sum(CASE WHEN reason IS NULL THEN length(snippet) END), 0)::BIGINT AS snippet_chars FROM f GROUP BY 1",
    "json_snippet_fields": "SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events",
    "target_path": "SELECT doc_id, '/data/services/services/' || lower(source) || '/' || lang || '.md' AS raw_path, '/data/services/' || lower(source) || '/' || lang || '.md' AS path FROM documents",
    "path_parts": r"SELECT page_id, coalesce(string_split(url, '/')[-2], 'unknown') AS parent, string_split(url, '/')[-1] AS base, regexp_replace(string_split(url, '/')[-1], '\.[^.]*$', '') AS stem FROM pages",
    "combined_features": f"""SELECT doc_id, md5(source || ' ' || lang || ' ' || text) AS query_md5, md5(source || ' ' || lang || ' ' || text || ' cause') AS training_md5,
        md5('Filename: ' || lang || '.md' || chr(10) || 'Content: ' || text) AS document_md5 FROM documents""",
    "confidence_parse": "SELECT vec_id, CASE WHEN label = 9 THEN 95.5 WHEN label < 3 THEN 95.0 WHEN label < 6 THEN 75.0 ELSE 50.0 END::DOUBLE AS confidence FROM embeddings",
    "confidence_band": f"""WITH {COS}, c AS (SELECT qid AS query_id, floor((round(score * 1000000)::BIGINT + 50) / 100.0::DOUBLE) / 100.0::DOUBLE AS confidence FROM b WHERE rank = 1)
        SELECT *, CASE WHEN confidence >= 80 THEN 'success' WHEN confidence >= 60 THEN 'warning' ELSE 'error' END AS band, printf('%.2f%%', confidence) AS shown FROM c""",
    "record_ids": "SELECT event_id, 'err_' || (row_number() OVER (ORDER BY event_id) + 1)::VARCHAR AS id FROM events",
    "token_counts": f"SELECT term, sum(tf)::BIGINT AS n, count(*) AS df FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY ALL) GROUP BY term",
    "bigram_counts": f"WITH t AS (SELECT {TOK} AS w FROM documents) SELECT term, count(*) AS n FROM (SELECT unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda x: x[1] || ' ' || x[2])) AS term FROM t WHERE len(w) > 1) GROUP BY term",
    "idf_table": f"WITH {TF} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "tfidf_weights": f"WITH {TF} SELECT doc_id, term, round(w, 6) AS w FROM w",
    "tfidf_top1": f"WITH {TOP} SELECT item_id, doc_id, score FROM best",
    "hashed_encode": f"SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS bucket, count(*) AS n FROM (SELECT doc_id, unnest({TOK}) AS t FROM documents) GROUP BY ALL",
    "cosine_top1": f"WITH {COS} SELECT qid AS query_id, id AS vec_id, score FROM b WHERE rank = 1",
    "cosine_topk": f"WITH {COS} SELECT qid AS query_id, rank, id AS vec_id, score FROM b WHERE rank <= 5",
    "l2_nearest": f"WITH {L2} SELECT qid AS query_id, id AS vec_id, d AS distance FROM o",
    "threshold_feedback": f"WITH {L2} SELECT qid AS query_id, id AS correction_id, d AS distance FROM f",
    "two_tier_search": f"""WITH {L2} SELECT q.qid AS query_id, CASE WHEN f.id IS NOT NULL THEN 'LEARNED' WHEN o.id IS NOT NULL THEN 'OFFICIAL' ELSE 'UNKNOWN' END AS source,
        coalesce(f.id, o.id) AS match_id, coalesce(f.d, o.d) AS distance, CASE WHEN f.id IS NOT NULL THEN 95.0 WHEN o.id IS NOT NULL THEN 75.0 ELSE 50.0 END::DOUBLE AS confidence
        FROM q LEFT JOIN f USING (qid) LEFT JOIN o ON o.qid = q.qid""",
    "knn_label_confusion": f"WITH {L2} SELECT a.label::BIGINT AS actual, p.label::BIGINT AS predicted, count(*) AS n FROM o JOIN v a ON a.id = o.qid JOIN v p ON p.id = o.id GROUP BY ALL",
    "path_exists_semi": "SELECT doc_id, quality::BIGINT AS quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)",
    "path_missing_anti": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "best_match_doc": f"WITH {CAT} SELECT source, lang, (SELECT min(path) FROM cat WHERE folder = source OR file = lang || '.md') AS path FROM (SELECT DISTINCT source, lang FROM documents)",
    "first_available": f"WITH {CAT} SELECT min(path) AS path FROM cat",
    "fallback_ladder": f"WITH {LADDER} SELECT qid, doc_path, confidence, source, is_fallback FROM y",
    "classify_response": f"""WITH {LADDER} SELECT method, source, CASE WHEN is_fallback THEN 'The predicted document was missing; a fallback was used.'
        WHEN doc_path NOT IN (SELECT path FROM cat) THEN 'The predicted document is missing and nothing replaces it.' END AS warning,
        CASE WHEN confidence >= 80 THEN 'success' WHEN confidence >= 60 THEN 'warning' ELSE 'error' END AS band, count(*) AS n FROM y GROUP BY ALL""",
    "method_dispatch": """SELECT item_id, m AS method, CASE WHEN trim(coalesce(text, '')) = '' THEN 400 WHEN m = 'ORACLE' THEN 400 WHEN m = 'RANDOM_FOREST' THEN 503 ELSE 200 END::BIGINT AS status,
        CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty snippet' WHEN m = 'ORACLE' THEN 'unknown method' WHEN m = 'RANDOM_FOREST' THEN 'method unavailable' END AS error
        FROM (SELECT item_id, text, ['VECTOR_DB', 'SEMANTIC_SEARCH', 'RANDOM_FOREST', 'ORACLE'][(item_id % 4 + 1)::INT] AS m FROM benchmark)""",
    "dataset_insert": "SELECT event_id, event_type, props FROM events UNION ALL SELECT max(event_id) + 1000000000, upper(event_type), NULL FROM events GROUP BY event_type",
    "dataset_update": "SELECT event_id, CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS event_type, CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN '{}' ELSE props END AS props FROM events",
    "dataset_delete": "SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events WHERE event_type <> 'click'",
    "docs_upsert": "SELECT doc_id, md5(text) AS content FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages) UNION ALL SELECT page_id, md5(html) FROM pages",
    "docs_delete": "SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)",
    "index_incremental": "SELECT doc_id, md5(text) AS content FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "feedback_append": f"WITH {FB} SELECT id, md5(text) AS text_md5, correct_doc_path, 'user' AS added_by, ts FROM c",
    "feedback_latest": f"WITH {FB} SELECT md5(text) AS text_md5, id, correct_doc_path FROM c QUALIFY row_number() OVER (PARTITION BY text ORDER BY ts DESC, id DESC, correct_doc_path DESC) = 1",
    "session_replay": "SELECT conv_id, turn, role, lag(role) OVER w AS before, lead(role) OVER w AS after, lower(trim(text)) IN ('q', 'quit', 'exit') AS leaves FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "batch_score": f"""WITH {TOP}, c AS (SELECT item_id, {PATH} AS doc_path, floor((round(score * 1000000)::BIGINT + 50) / 100.0::DOUBLE) / 100.0::DOUBLE AS confidence FROM best JOIN documents USING (doc_id))
        SELECT *, CASE WHEN confidence >= 80 THEN 'success' WHEN confidence >= 60 THEN 'warning' ELSE 'error' END AS band FROM c""",
    "status_counts": "SELECT true AS healthy, 'RF: Not loaded, Semantic: Ready' AS model_status, 'Ready' AS vector_db_status, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vector_db_records, (SELECT count(*) FROM conversations) AS learned_corrections",
    "request_decode": """SELECT doc_id AS qid, CASE WHEN bad THEN '' ELSE coalesce(source, '') END AS service, CASE WHEN bad THEN '' ELSE coalesce(lang, '') END AS category,
        md5(CASE WHEN bad THEN '' ELSE coalesce(text, '') END) AS snippet_md5, CASE WHEN NOT bad AND doc_id % 2 = 0 THEN 'SEMANTIC_SEARCH' ELSE 'VECTOR_DB' END AS method,
        CASE WHEN empty THEN 400 ELSE 200 END::BIGINT AS status, CASE WHEN empty THEN 'empty snippet' END AS error
        FROM (SELECT *, bad OR trim(coalesce(text, ''), E' \\t\\n\\r\\f\\v') = '' AS empty FROM (SELECT *, doc_id % 50 = 7 AS bad FROM documents))""",
    "response_encode": f"""WITH {LADDER}, z AS (SELECT *, CASE WHEN is_fallback THEN 'The predicted document was missing; a fallback was used.'
        WHEN doc_path NOT IN (SELECT path FROM cat) THEN 'The predicted document is missing and nothing replaces it.' END AS warning FROM y)
        SELECT qid, '{{"doc_path":"' || doc_path || '","confidence":' || confidence::VARCHAR || ',"source":"' || source || '"' || coalesce(',"warning":"' || warning || '"', '') || '}}' AS body FROM z""",
    "local_times": "SELECT event_id, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS shown FROM events",
    "feedback_stream": "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
