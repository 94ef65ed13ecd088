"""The queries again in DuckDB's SQL, over the driver's tables."""

from __future__ import annotations

from ..functions.text import NOT_FOUND, SNIPPET_CHARS
from ..sources.fixtures import SQL as FIXTURES

SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CURSOR = 500


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n]})" for n in names)


def _norm(t: str) -> str:
    return f"trim(regexp_replace(coalesce({t}, ''), '{SPACE}+', ' ', 'g'))"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _ws(t: str) -> str:
    return f"list_filter(string_split({_norm(t)}, ' '), lambda x: x <> '')"


def _words(t: str) -> str:
    return f"regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9]+')"


def _snippet(t: str, q: str) -> str:
    first = f"list_min(list_filter(list_transform(list_filter({_words(q)}, lambda x: length(x) > 1), lambda x: strpos(lower({t}), x)), lambda p: p > 0))"
    cut = _strip(f"substr({t}, CAST(greatest(0, coalesce({first}, 1) - 1 - {SNIPPET_CHARS // 3}) + 1 AS BIGINT), {SNIPPET_CHARS})")
    return f"CASE WHEN length({cut}) < length({t}) THEN {cut} || '...' ELSE {cut} END"


_NAME = r"regexp_extract({k}, '([^/]*)$', 1)"


def _suffix(k: str) -> str:
    return rf"regexp_extract({k}, '[^/](\.[^./]+)$', 1)"


_OLD = "old_chunks AS (SELECT doc_id, chunk_id, 'old ' || text AS text FROM chunks)"
_NEW = "new_chunks AS (SELECT doc_id, chunk_id, 'new ' || text AS text FROM chunks)"


def _net(table: str) -> str:
    return f"SELECT doc_id, arg_max(op, change_id) AS op FROM {table} WHERE doc_id <> '' AND op IN ('upsert', 'delete') GROUP BY doc_id"


_NORMAL = (
    _with("index_events")
    + f""",
parsed AS (SELECT message_id, arrival_seq, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM index_events),
fields AS (SELECT message_id, arrival_seq,
  CASE WHEN json_type(j, '$.doc_id') = 'VARCHAR' THEN {_strip("json_extract_string(j, '$.doc_id')")} END AS doc_id,
  CASE WHEN json_type(j, '$.op') = 'VARCHAR' THEN json_extract_string(j, '$.op') END AS op,
  CASE WHEN json_type(j, '$.corpus_version') = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$.corpus_version') AS BIGINT)
    ELSE CAST(trunc(TRY_CAST(json_extract_string(j, '$.corpus_version') AS DOUBLE)) AS BIGINT) END AS corpus_version FROM parsed),
normal AS (SELECT message_id, arrival_seq, doc_id, op, corpus_version,
  coalesce(doc_id <> '' AND op IN ('upsert', 'delete') AND corpus_version > 0, false) AS valid FROM fields),
valid AS (SELECT message_id, arrival_seq, doc_id, op, corpus_version FROM normal WHERE valid),
latest AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY corpus_version DESC, arrival_seq DESC) = 1)"""
)


def _object(kind: str, bucket: str | None) -> str:
    extra = f"WHEN json_extract_string(e, '$.s3.bucket.name') <> '{bucket}' THEN 'unrelated bucket'" if bucket else ""
    string = lambda p: f"(CASE WHEN json_type(e, '{p}') = 'VARCHAR' THEN json_extract_string(e, '{p}') END)"
    decoded = f"url_decode(replace({string('$.s3.object.key')}, '+', ' '))"
    return (
        _with("object_events")
        + f""",
parsed AS (SELECT message_id, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM object_events),
listed AS (SELECT message_id, ok, coalesce(json_type(j, '$.Records') = 'ARRAY', false) AS is_list, j FROM parsed),
rows AS (SELECT message_id, ok, is_list, unnest(CASE WHEN is_list THEN CAST(json_extract(j, '$.Records') AS JSON[]) ELSE [CAST(NULL AS JSON)] END) AS e FROM listed)
SELECT message_id, {string('$.s3.bucket.name')} AS bucket, {decoded} AS doc_id, {string('$.eventName')} AS event_name,
  CASE WHEN NOT ok THEN 'invalid json body' WHEN NOT is_list THEN 'unrecognized message'
    WHEN coalesce(json_type(e), '') <> 'OBJECT' THEN 'event is not an object'
    WHEN coalesce(json_type(e, '$.s3'), '') <> 'OBJECT' THEN 'missing s3'
    WHEN coalesce(json_type(e, '$.s3.bucket'), '') <> 'OBJECT' THEN 'missing bucket'
    WHEN coalesce({string('$.s3.bucket.name')}, '') = '' THEN 'missing bucket name'
    WHEN coalesce(json_type(e, '$.s3.object'), '') <> 'OBJECT' THEN 'missing object'
    WHEN coalesce({string('$.s3.object.key')}, '') = '' THEN 'missing object key'
    WHEN coalesce({string('$.eventName')}, '') = '' THEN 'missing event name'
    WHEN NOT starts_with({string('$.eventName')}, '{kind}') THEN 'other event' {extra} END AS reject_reason
FROM rows"""
    )


# The state machine on strings: status|request|outcome after each action, folded from the left.
_STEP = """
CASE
 WHEN a = 'claim_ingest' AND s = '' THEN 'ingesting|' || r || '|claimed'
 WHEN a = 'claim_ingest' AND s = 'ingest failed' THEN 'ingesting|' || r || '|reclaimed'
 WHEN a = 'claim_ingest' THEN s || '|' || h || '|skipped ingestion'
 WHEN a = 'finalize_ingest' AND s = 'ingesting' AND h = r THEN 'indexed|' || h || '|indexed'
 WHEN a = 'fail_ingest' AND s <> '' THEN 'ingest failed|' || h || '|ingest failed'
 WHEN a = 'claim_delete' AND s IN ('indexed', 'delete failed') THEN 'deleting|' || r || '|deleting'
 WHEN a = 'claim_delete' THEN s || '|' || h || '|skipped deletion'
 WHEN a = 'finalize_delete' AND s = 'deleting' AND h = r THEN 'deleted|' || h || '|deleted'
 ELSE s || '|' || h || '|guard failed' END"""
_MANIFEST = (
    _with("manifest_actions").replace("WITH", "WITH RECURSIVE", 1)
    + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM manifest_actions),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, '' AS action, '||' AS state FROM manifest_actions GROUP BY doc_id
  UNION ALL
  SELECT doc_id, n, seq, action, {_STEP} FROM (
    SELECT w.doc_id, x.n, x.seq, x.action, x.action AS a, x.req_id AS r, split_part(w.state, '|', 1) AS s, split_part(w.state, '|', 2) AS h
    FROM walk w JOIN numbered x ON w.doc_id = x.doc_id AND x.n = w.n + 1)
)"""
)

_BM25 = (
    _with("chunks", "search_queries")
    + f""",
words AS MATERIALIZED (SELECT doc_id, chunk_ord, text, {_ws('text')} AS w FROM chunks),
lens AS (SELECT doc_id, chunk_ord, len(w) AS dl FROM words),
totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
tf AS MATERIALIZED (SELECT term, doc_id, chunk_ord, count(*) AS tf FROM (SELECT doc_id, chunk_ord, unnest(w) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw_idf AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, totals),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw_idf) ELSE idf END AS idf FROM raw_idf),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_ws('query')}) AS term FROM search_queries) GROUP BY ALL),
hits AS (SELECT query_id, tf.doc_id, tf.chunk_ord, round(sum(qtf * idf * (2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN lens ON tf.doc_id = lens.doc_id AND tf.chunk_ord = lens.chunk_ord, totals GROUP BY ALL),
everything AS (SELECT query_id, doc_id, chunk_ord, coalesce(score, 0) AS score FROM (SELECT query_id, doc_id, chunk_ord FROM search_queries, lens) LEFT JOIN hits USING (query_id, doc_id, chunk_ord)),
top AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_ord) - 1 AS INTEGER) AS rank FROM everything QUALIFY rank < 20)"""
)


def _reranked(query: str) -> str:
    return f""",
asked AS (SELECT query_id, query AS plain, {query} AS query FROM search_queries),
pairs AS (SELECT query_id, doc_id, chunk_ord, rank, asked.query, words.text, list_distinct({_words('asked.query')}) AS q, CAST(len(list_intersect(list_distinct({_words('asked.query')}), list_distinct({_words('words.text')}))) AS INTEGER) AS overlap
  FROM top JOIN words USING (doc_id, chunk_ord) JOIN asked USING (query_id)),
best AS (SELECT query_id, doc_id, chunk_ord, overlap, CAST(row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) AS INTEGER) AS place, text, query FROM pairs WHERE overlap > 0 OR len(q) = 0 QUALIFY place <= 5)"""


_SENTENCES = (
    _with("chunks")
    + f""",
texts AS (SELECT doc_id, {_norm('text')} AS t FROM chunks),
split AS (SELECT doc_id, string_split(regexp_replace(t, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM texts WHERE t <> ''),
sentences AS MATERIALIZED (SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS i, unnest(s) AS sentence FROM split),
around AS (SELECT doc_id, i, concat_ws(' ', lag(sentence) OVER w, sentence, lead(sentence) OVER w) AS text FROM sentences WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
counts AS MATERIALIZED (SELECT doc_id, i, term, count(*) AS c FROM (SELECT doc_id, i, unnest({_words('text')}) AS term FROM around) GROUP BY ALL),
norms AS (SELECT doc_id, i, sum(c * c) AS norm FROM counts GROUP BY ALL),
dots AS (SELECT a.doc_id, a.i, sum(a.c * b.c) AS dot FROM counts a JOIN counts b ON a.doc_id = b.doc_id AND a.term = b.term AND b.i = a.i + 1 GROUP BY ALL),
distances AS MATERIALIZED (SELECT s.doc_id, s.i, round(1 - CASE WHEN coalesce(x.norm, 0) > 0 AND coalesce(y.norm, 0) > 0 THEN coalesce(dot, 0) / (sqrt(y.norm) * sqrt(x.norm)) ELSE 0 END, 9) AS distance
  FROM sentences s JOIN sentences n ON s.doc_id = n.doc_id AND n.i = s.i + 1
  LEFT JOIN norms x ON x.doc_id = s.doc_id AND x.i = s.i LEFT JOIN norms y ON y.doc_id = s.doc_id AND y.i = s.i + 1 LEFT JOIN dots ON dots.doc_id = s.doc_id AND dots.i = s.i),
breaks AS MATERIALIZED (SELECT *, distance > threshold AS is_break FROM (SELECT doc_id, i, distance, round(quantile_cont(distance, 0.9) OVER (PARTITION BY doc_id), 9) AS threshold FROM distances))"""
)
_CHUNKED = (
    _SENTENCES
    + """, numbered AS (SELECT s.doc_id, s.i, sentence, CAST(coalesce(sum(CASE WHEN is_break THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id ORDER BY s.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS INTEGER) AS chunk_ord FROM sentences s LEFT JOIN breaks b ON s.doc_id = b.doc_id AND s.i = b.i),
semantic AS MATERIALIZED (SELECT doc_id, chunk_ord, string_agg(sentence, ' ' ORDER BY i) AS text FROM numbered GROUP BY doc_id, chunk_ord)"""
)
_CHUNK_ID = "replace(replace(doc_id, 'raws/', ''), '.txt', '') || '_chunk_' || printf('%04d', {n})"

_NUMBER = "CAST(regexp_extract({k}, '([0-9]+)', 1) AS BIGINT)"
_INGESTED = (
    _CHUNKED.replace(FIXTURES["chunks"], "SELECT key AS doc_id, 1 AS chunk_ord, '' AS chunk_id, text FROM (" + FIXTURES["raw_objects"] + ") WHERE (ends_with(key, '.txt') OR ends_with(key, '.md')) AND " + _NUMBER.format(k="key") + " % 13 <> 0")
    + ", "
    + _with("raw_objects", "manifest_before", "created_messages")[5:]
    + f""",
old AS (SELECT key AS doc_id, {_NUMBER.format(k='key')} AS n, status, text FROM raw_objects LEFT JOIN manifest_before ON doc_id = key),
work AS (SELECT doc_id, n, text FROM old WHERE coalesce(status, 'ingest failed') = 'ingest failed' AND n % 17 <> 0),
failed AS (SELECT doc_id, CASE WHEN n % 13 = 0 THEN 'no such object' WHEN ends_with(doc_id, '.pdf') THEN 'no PDF reader is plugged in' WHEN ends_with(doc_id, '.docx') THEN 'BadZipFile: File is not a zip file'
  WHEN ends_with(doc_id, '.html') THEN 'Unsupported file type' WHEN {_norm('text')} = '' THEN 'document text extraction failed' END AS error_message FROM work),
good AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS change_id FROM failed WHERE error_message IS NULL),
words AS (SELECT doc_id, chunk_ord, text, len({_words('text')}) AS w FROM semantic),
made AS (SELECT doc_id, count(*) AS n_chunks, sum(length(text)) AS chunk_chars, regexp_replace(replace(doc_id, 'raws/', ''), '[.][^.]*$', '') || '_chunk_' || printf('%04d', max(chunk_ord)) AS last_chunk,
  CASE WHEN count(*) > 200 THEN ceil(count(*) / greatest(1, count(*) // 5)) ELSE 1 END AS n_batches, sum(w) AS n_words FROM words WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY doc_id)"""
)

ORACLES = {
    "ingest_batch": _INGESTED
    + """ SELECT d.doc_id, CASE WHEN g.doc_id IS NOT NULL THEN 'indexed' WHEN f.doc_id IS NOT NULL THEN 'ingest failed' ELSE d.status END AS status, CASE WHEN f.doc_id IS NULL THEN 'before' ELSE 'ingest-0' END AS req_id, f.error_message, CAST(coalesce(n_chunks, 0) AS INTEGER) AS n_keys,
  n_chunks, CAST(chunk_chars AS BIGINT) AS chunk_chars, last_chunk, CAST(n_batches AS BIGINT) AS n_batches, CAST(n_words AS BIGINT) AS n_words, change_id, CASE WHEN g.doc_id IS NOT NULL THEN 'upsert' END AS op
FROM old d LEFT JOIN failed f ON f.doc_id = d.doc_id LEFT JOIN good g ON g.doc_id = d.doc_id LEFT JOIN made m ON m.doc_id = d.doc_id WHERE d.status IS NOT NULL OR f.doc_id IS NOT NULL""",
    "delete_batch": _with("chunks", "manifest_full")
    + f""", asked AS (SELECT *, {_NUMBER.format(k='doc_id')} % 3 <> 0 AND {_NUMBER.format(k='doc_id')} % 5 <> 0 AND status IN ('indexed', 'delete failed') AS gone FROM manifest_full),
ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS change_id FROM asked WHERE gone)
SELECT a.doc_id, CASE WHEN gone THEN 'deleted' ELSE status END AS status, CASE WHEN gone THEN 'delete-0' ELSE 'before' END AS req_id, CASE WHEN gone OR status = 'deleted' THEN [] ELSE [a.chunk_id] END AS vector_keys,
  CASE WHEN NOT gone AND status <> 'deleted' THEN 1 END AS n_chunks, CASE WHEN NOT gone AND status <> 'deleted' THEN CAST(length(c.text) AS BIGINT) END AS chunk_chars, CASE WHEN NOT gone AND status <> 'deleted' THEN 1 END AS n_vectors, change_id, CASE WHEN gone THEN 'delete' END AS op
FROM asked a JOIN chunks c ON c.doc_id = a.doc_id LEFT JOIN ids ON ids.doc_id = a.doc_id""",
    "upload_plan": _with("raw_objects") + " SELECT replace(key, 'raws/', '') AS name, octet_length(encode(text)) AS size, 'raws/' || regexp_replace(replace(key, 'raws/', ''), '[.][^.]*$', '') || '-(id)' || regexp_extract(key, '[.][^.]*$') AS key FROM raw_objects",
    "list_documents": _with("raw_objects") + " SELECT key AS \"docId\", original_filename AS \"fileName\", strftime(to_timestamp(1700000000 + n_chars * 60) AT TIME ZONE 'UTC', '%Y-%m-%d') AS \"uploadedAt\" FROM raw_objects",
    "delete_raw_document": _with("raw_objects") + " SELECT key, n_chars FROM raw_objects WHERE NOT ends_with(key, '.html')",
    "extract_text_route": _with("raw_objects") + f" SELECT key, s AS suffix, CASE s WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.txt' THEN 'text' WHEN '.md' THEN 'text' ELSE 'unsupported' END AS route FROM (SELECT key, lower({_suffix('key')}) AS s FROM raw_objects)",
    "decode_utf8_replace": _with("raw_objects") + " SELECT key, text || chr(65533) || 'A' AS text FROM raw_objects",
    "chunks_to_jsonl": _with("chunks") + " SELECT 'chunks/' || replace(replace(doc_id, 'raws/', ''), '.txt', '') || '_chunks.jsonl' AS file_key, doc_id, chunk_id, text FROM chunks",
    "load_chunks": _with("chunks") + ", l AS (SELECT doc_id, chunk_id, text, CAST(to_json({'doc_id': doc_id, 'chunk_id': chunk_id, 'text': text}) AS VARCHAR) AS line FROM chunks) SELECT chunk_id, doc_id, CASE WHEN length(line) % 3 = 0 THEN 'again ' || text ELSE text END AS text FROM l",
    "delete_chunks": _with("chunks", "manifest") + " SELECT doc_id, chunk_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM manifest WHERE status = 'deleted')",
    "vector_batches": _with("vector_records") + " SELECT 'all' AS doc_id, key, CAST((row_number() OVER (ORDER BY key) - 1) // CASE WHEN count(*) OVER () > 200 THEN greatest(1, count(*) OVER () // 5) ELSE count(*) OVER () END AS BIGINT) AS batch_no FROM vector_records",
    "vector_batch_summary": _with("vector_records") + """, n AS (SELECT doc_id, count(*) AS n_vectors FROM (SELECT doc_id FROM vector_records UNION ALL SELECT 'all' FROM vector_records) GROUP BY doc_id),
b AS (SELECT *, CASE WHEN n_vectors > 200 THEN greatest(1, n_vectors // 5) ELSE n_vectors END AS batch_size FROM n)
SELECT doc_id, n_vectors, n_vectors > 200 AS batched, CAST(batch_size AS BIGINT) AS batch_size, CAST((n_vectors + batch_size - 1) // batch_size AS BIGINT) AS n_batches FROM b""",
    "delete_vectors": _with("vector_records", "manifest") + " SELECT doc_id, key FROM vector_records WHERE doc_id NOT IN (SELECT doc_id FROM manifest WHERE status = 'deleted')",
    "vector_topk": _with("vector_records") + """, s AS (SELECT q.key AS query_key, r.key, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6) AS score FROM vector_records q, vector_records r WHERE CAST(regexp_extract(q.key, '_chunk_([0-9]+)$', 1) AS BIGINT) % 100 = 0 AND q.key <> r.key)
SELECT query_key, key, score, CAST(row_number() OVER (PARTITION BY query_key ORDER BY score DESC, key) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""",
    "indexed_doc_ids": _with("manifest") + " SELECT doc_id FROM manifest WHERE status = 'indexed'",
    "append_change_log": _with("change_log", "chunks") + " SELECT (SELECT max(change_id) FROM change_log) + row_number() OVER (ORDER BY 'new/' || doc_id) AS change_id, 'new/' || doc_id AS doc_id, 'upsert' AS op FROM chunks",
    "changes_since": _with("change_log") + f" SELECT change_id, doc_id, op FROM change_log WHERE change_id > {CURSOR}",
    "latest_change_id": _with("change_log") + " SELECT coalesce(max(change_id), 0) AS latest_change_id FROM change_log",
    "net_changes": _with("change_log") + f", since AS (SELECT * FROM change_log WHERE change_id > {CURSOR}) " + _net("since"),
    "advance_cursor": _with("change_log") + f" SELECT coalesce(max(change_id), {CURSOR}) AS cursor FROM change_log WHERE change_id > {CURSOR}",
    "is_stale": _with("change_log") + f" SELECT coalesce(max(change_id), 0) <> {CURSOR} AS is_stale FROM change_log",
    "bootstrap_corpus": _with("chunks", "manifest") + f", {_OLD} SELECT doc_id, chunk_id, text FROM old_chunks WHERE doc_id IN (SELECT doc_id FROM manifest WHERE status = 'indexed')",
    "apply_delta": _with("chunks", "manifest", "doc_changes") + f""", {_OLD}, {_NEW}, net AS ({_net('doc_changes')})
SELECT doc_id, chunk_id, text FROM old_chunks WHERE doc_id IN (SELECT doc_id FROM manifest WHERE status = 'indexed') AND doc_id NOT IN (SELECT doc_id FROM net)
UNION ALL SELECT doc_id, chunk_id, text FROM new_chunks WHERE NOT ends_with(doc_id, '9.txt') AND doc_id IN (SELECT doc_id FROM net WHERE op = 'upsert')""",
    "remove_doc": _with("chunks", "manifest") + f", {_OLD} SELECT doc_id, chunk_id, text FROM old_chunks WHERE doc_id NOT IN (SELECT doc_id FROM manifest WHERE status = 'deleted')",
    "merge_chunks": _with("chunks", "doc_changes") + f", {_OLD}, {_NEW}, net AS ({_net('doc_changes')}), fresh AS (SELECT doc_id FROM net WHERE op = 'upsert') SELECT chunk_id, doc_id, text FROM old_chunks WHERE doc_id NOT IN (SELECT doc_id FROM fresh) UNION ALL SELECT chunk_id, doc_id, text FROM new_chunks WHERE doc_id IN (SELECT doc_id FROM fresh)",
    "doc_chunk_index": _with("vector_records") + " SELECT doc_id, list_sort(list_distinct(list(key))) AS chunk_ids FROM vector_records GROUP BY doc_id",
    "chunk_to_doc": _with("vector_records") + " SELECT key AS chunk_id, max(doc_id) AS doc_id FROM vector_records GROUP BY key",
    "chunk_payload": _with("chunks") + " SELECT chunk_id AS id, text, doc_id AS metadata_doc_id FROM chunks",
    "chunk_ids": _with("vector_records") + " SELECT doc_id, key, " + _CHUNK_ID.format(n="row_number() OVER (PARTITION BY doc_id ORDER BY key) + 9990") + " AS chunk_id FROM vector_records",
    "embed_chunks": _with("chunks") + f", w AS (SELECT doc_id, chunk_id, list_transform({_words('text')}, lambda x: CAST('0x' || substr(md5(x), 1, 2) AS INTEGER) % 64) AS h FROM chunks) SELECT chunk_id AS key, doc_id, list_transform(range(64), lambda i: CAST(len(list_filter(h, lambda x: x = i)) AS FLOAT)) AS embedding FROM w",
    "load_snapshot": "SELECT 'raws/doc-' || doc_id || '.txt' AS doc_id, 'doc-' || doc_id || '_chunk_0001' AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'again ' ELSE '' END || text AS page_content FROM documents WHERE text IS NOT NULL",
    "publish_snapshot": _with("chunks") + f", {_OLD} SELECT chunk_id AS id, text AS page_content, doc_id, chunk_id FROM old_chunks",
    "snapshot_stats": _NORMAL + "," + _with("chunks", "manifest", "change_log")[4:] + """
SELECT greatest((SELECT max(corpus_version) FROM valid), (SELECT max(change_id) FROM change_log)) AS corpus_version, count(DISTINCT doc_id) AS doc_count, count(*) AS chunk_count, (SELECT count(*) FROM latest) AS coalesced_event_count
FROM chunks WHERE doc_id IN (SELECT doc_id FROM manifest WHERE status = 'indexed')""",
    "read_pointer": _with("change_log") + " SELECT coalesce(max(change_id), 0) AS corpus_version, 'bm25/v' || CAST(max(change_id) AS VARCHAR) AS key FROM change_log WHERE change_id % 50 = 0",
    "rebuild_needed": _NORMAL + "," + _with("change_log")[4:] + " SELECT (SELECT coalesce(max(change_id), 0) FROM change_log WHERE change_id % 50 = 0) < (SELECT max(corpus_version) FROM valid) AS rebuild_needed",
    "rebuild_guard": _with("change_log") + f""", since AS (SELECT * FROM change_log WHERE change_id > {CURSOR}), net AS ({_net('since')}), unknown AS (SELECT * FROM since WHERE op = 'noop'), nothing AS ({_net('unknown')})
SELECT change_id AS corpus_version, CASE WHEN change_id >= {CURSOR} THEN 'skip' WHEN CASE WHEN change_id < 200 THEN (SELECT count(*) FROM nothing) ELSE (SELECT count(*) FROM net) END = 0 THEN 'error' ELSE 'rebuild' END AS decision FROM change_log WHERE change_id % 50 = 0""",
    "validate_publish_event": _NORMAL + """ SELECT message_id, coalesce(doc_id <> '' AND op IN ('upsert', 'delete') AND (SELECT json_type(j, '$.corpus_version') IN ('BIGINT', 'UBIGINT') FROM parsed p WHERE p.message_id = fields.message_id) AND corpus_version <> 0, false) AS publishable FROM fields""",
    "validate_created_events": _object("ObjectCreated:", None),
    "validate_removed_events": _object("ObjectRemoved:", "corpus-bucket"),
    "normalize_index_events": _NORMAL + " SELECT message_id, arrival_seq, CASE WHEN valid THEN doc_id END AS doc_id, CASE WHEN valid THEN op END AS op, CASE WHEN valid THEN corpus_version END AS corpus_version, valid FROM normal",
    "coalesce_events": _NORMAL + " SELECT doc_id, op, corpus_version, arrival_seq FROM latest",
    "target_version": _NORMAL + " SELECT max(corpus_version) AS target_version FROM valid",
    "batch_failures": _NORMAL + ' SELECT message_id AS "itemIdentifier" FROM valid',
    "manifest_fold": _MANIFEST + " SELECT doc_id, split_part(state, '|', 1) AS status, split_part(state, '|', 2) AS req_id FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1 AND split_part(state, '|', 1) <> ''",
    "claim_outcomes": _MANIFEST + " SELECT doc_id, seq, action, split_part(state, '|', 3) AS outcome FROM walk WHERE n > 0",
    "validate_chat": _with("chat_requests") + f" SELECT conv_id, turn, role, {_strip('coalesce(message, chr(32))')} AS message, CASE WHEN coalesce(role, '') NOT IN ('user', 'assistant') THEN 'unknown role' WHEN {_strip('coalesce(message, chr(32))')} = '' THEN 'message is required' END AS reject_reason FROM chat_requests",
    "tokenize_overlap": _with("chunks") + f" SELECT doc_id, list_sort(list_distinct({_words('text')})) AS tokens FROM chunks",
    "tokenize_ws": _with("chunks") + f" SELECT doc_id, {_ws('text')} AS tokens FROM chunks",
    "normalize_whitespace": _with("chunks") + f" SELECT doc_id, {_norm('text')} AS text FROM chunks",
    "snippet": _with("chunks") + f" SELECT doc_id, {_snippet('text', chr(39) + 'Sh enti, or X the' + chr(39))} AS hit, {_snippet('text', chr(39) + 'zzzz q' + chr(39))} AS no_hit FROM chunks",
    "decode_keys": _with("raw_objects") + " SELECT key, replace(key, 'doc-', 'doc (') || ')é' AS decoded, key || ' %zz' AS kept FROM raw_objects",
    "doc_name": _with("raw_objects") + " SELECT key, regexp_replace(replace(replace(key, '-', '.v1-'), 'raws/', ''), '\\.[^.]*$', '') AS name FROM raw_objects",
    "chunk_key": _with("raw_objects") + " SELECT key, 'chunks/' || regexp_replace(replace(key, 'raws/', ''), '\\.[^.]*$', '') || '_chunks.jsonl' AS chunk_key FROM raw_objects",
    "bm25_doc_stats": _BM25 + " SELECT doc_id, chunk_ord, CAST(dl AS BIGINT) AS dl FROM lens",
    "bm25_term_stats": _BM25 + " SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": _BM25 + " SELECT query_id, doc_id, chunk_ord, score, rank FROM top",
    "rerank_overlap": _BM25 + _reranked("query") + " SELECT query_id, doc_id, chunk_ord, overlap, place AS rank FROM best",
    "rerank_empty_tokens": _BM25 + _reranked("regexp_replace(regexp_replace(query, '[A-Za-z0-9]+', '?', 'g'), '[^?]+', ' ', 'g')") + " SELECT query_id, doc_id, chunk_ord, overlap, place AS rank FROM best",
    "chat_answer": _BM25 + _reranked("query") + f""", lines AS (SELECT query_id, string_agg(CAST(place AS VARCHAR) || ') ' || {_snippet('text', 'query')}, chr(10) ORDER BY place) AS answer FROM best GROUP BY query_id)
SELECT query_id, coalesce(answer, '{NOT_FOUND.replace("'", "''")}') AS answer FROM search_queries LEFT JOIN lines USING (query_id)""",
    "sentence_distances": _SENTENCES + " SELECT doc_id, i, distance FROM distances",
    "chunk_breakpoints": _SENTENCES + " SELECT doc_id, i, distance, threshold, is_break FROM breaks",
    "semantic_chunks": _CHUNKED + " SELECT doc_id, chunk_ord, " + _CHUNK_ID.format(n="chunk_ord") + " AS chunk_id, text FROM semantic",
    "semantic_search": _CHUNKED + "," + _BM25[4:].replace(FIXTURES["chunks"], "SELECT doc_id, chunk_ord, text FROM semantic").replace("chunks AS (", "parts AS (", 1).replace("FROM chunks)", "FROM parts)") + _reranked("query") + " SELECT query_id, doc_id, chunk_ord, overlap, place AS rank FROM best",
}
