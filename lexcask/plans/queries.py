"""Every query of the retrieval engine over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import bm25, changelog, chunking, corpus, embedding, events, manifest, search, segments, snapshot, vectors
from ..sources import commits, lake, store
from ..sources.fixtures import dealt, frame
from ..sources.scratch import shared_folder
from ..streaming import workers

BUCKET = "corpus-bucket"
#: A cursor and a snapshot's version in the middle of the log.
CURSOR = 500


def _queries(spark, d):
    return frame(spark, d, "search_queries")


def _odd_queries(spark, d):
    """Queries without a word: the benchmark's words, each as question marks."""
    return _queries(spark, d).withColumn("query", F.regexp_replace("query", "[A-Za-z0-9]+", "?")).withColumn("query", F.regexp_replace("query", "[^?]+", " "))


#: The indexes of this process by session, table and its state: as a reader between two refreshes, queries share one.
_INDEXES: dict[tuple, tuple] = {}


def _corpus(spark, d, semantic=False):
    """The chunks of documents, or their semantic chunks from files, and the kept index of them."""
    fs, path = commits.filesystem(spark, f"{d}/documents.parquet")
    seen = fs.getFileStatus(path)
    key = (spark.sparkContext.applicationId, path.toString(), seen.getModificationTime(), seen.getLen(), semantic)
    if key not in _INDEXES:
        root = shared_folder(spark, "index")
        chunks = frame(spark, d, "chunks").select("doc_id", "chunk_ord", "text")
        if semantic:
            chunking.semantic_chunks(dealt(_docs(spark, d))).select("doc_id", "chunk_ord", "text").write.parquet(f"{root}/chunks")
            chunks = spark.read.parquet(f"{root}/chunks")
        _INDEXES[key] = (f"{root}/chunks" if semantic else None, segments.build(dealt(chunks), f"{root}/segments"))
    written, index = _INDEXES[key]
    return (spark.read.parquet(written) if written else dealt(frame(spark, d, "chunks"))), index


def _valid(spark, d):
    return events.normalize_index_events(frame(spark, d, "index_events")).filter("valid")


def _docs(spark, d):
    return frame(spark, d, "chunks").select("doc_id", "text")


def _old_chunks(spark, d):
    return frame(spark, d, "chunks").select("doc_id", "chunk_id", F.concat(F.lit("old "), "text").alias("text"))


def _new_chunks(spark, d):
    return frame(spark, d, "chunks").select("doc_id", "chunk_id", F.concat(F.lit("new "), "text").alias("text"))


def upload_plan(spark, d):
    rows = frame(spark, d, "raw_objects")
    plan = lake.upload_plan(rows.select(F.concat(F.lit("in/"), keys.base_name(F.col("key"))).alias("filename"), F.encode("text", "utf-8").alias("content")))
    # Every key has an id of its own, which stands here as (id).
    return plan.withColumn("key", F.regexp_replace("key", "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "(id)"))


def list_documents(spark, d):
    rows = frame(spark, d, "raw_objects").withColumn("last_modified", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n_chars") * 60))
    return lake.listing(rows)


def delete_raw_document(spark, d):
    rows = frame(spark, d, "raw_objects").select("key", "n_chars")
    gone = rows.filter("key LIKE '%.html'").select("key")
    return rows.join(gone, "key", "left_anti")


def extract_text_route(spark, d):
    return frame(spark, d, "raw_objects").select("key", keys.suffix(F.col("key")).alias("suffix"), keys.reader_route(F.col("key")).alias("route"))


def decode_utf8_replace(spark, d):
    return frame(spark, d, "raw_objects").select("key", text.decode_utf8(F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF41")))).alias("text"))


def chunks_to_jsonl(spark, d):
    out = corpus.chunks_to_jsonl(frame(spark, d, "chunks"))
    return out.select("file_key", F.get_json_object("line", "$.doc_id").alias("doc_id"), F.get_json_object("line", "$.chunk_id").alias("chunk_id"), F.get_json_object("line", "$.text").alias("text"))


def load_chunks(spark, d):
    rows = frame(spark, d, "chunks").select(F.col("chunk_ord").alias("line_no"), F.to_json(F.struct("doc_id", "chunk_id", "text")).alias("line"))
    twice = rows.unionByName(rows.filter(F.length("line") % 3 == 0).select(F.lit(2).alias("line_no"), F.replace("line", F.lit('"text":"'), F.lit('"text":"again ')).alias("line")))
    return corpus.load_lines(twice.unionByName(rows.select(F.lit(3).alias("line_no"), F.lit("  ").alias("line"))))


def delete_chunks(spark, d):
    chunks = frame(spark, d, "chunks").select("doc_id", "chunk_id")
    return corpus.remove_docs(chunks, _deleted(spark, d))


def vector_batches(spark, d):
    return vectors.batches(frame(spark, d, "vector_records").withColumn("doc_id", F.lit("all")))


def vector_batch_summary(spark, d):
    rows = frame(spark, d, "vector_records")
    return vectors.batch_summary(rows.select("doc_id", "key").unionByName(rows.select(F.lit("all").alias("doc_id"), "key")))


def _deleted(spark, d):
    return frame(spark, d, "manifest").filter("status = 'deleted'").select("doc_id")


def delete_vectors(spark, d):
    rows = frame(spark, d, "vector_records")
    # The keys that the manifest's rows of deleted documents hold.
    claimed = rows.join(_deleted(spark, d), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("key").alias("vector_keys"))
    return vectors.delete(rows.select("doc_id", "key"), claimed)


def vector_topk(spark, d):
    rows = frame(spark, d, "vector_records")
    # The vector's id ends the key.
    asked = rows.filter(F.regexp_extract("key", "_chunk_([0-9]+)$", 1).cast("long") % 100 == 0).select(F.col("key").alias("query_key"), F.col("embedding").alias("query"))
    return vectors.top_k(asked, rows.select("key", "embedding"))


def indexed_doc_ids(spark, d):
    return corpus.indexed_doc_ids(frame(spark, d, "manifest"))


def append_change_log(spark, d):
    log = frame(spark, d, "change_log").select("change_id", "doc_id", "op")
    new = frame(spark, d, "chunks").select(F.concat(F.lit("new/"), "doc_id").alias("doc_id"), F.lit("upsert").alias("op"))
    return changelog.append(log, new, "doc_id")


def changes_since(spark, d):
    return changelog.changes_since(frame(spark, d, "change_log"), CURSOR)


def latest_change_id(spark, d):
    return changelog.latest_change_id(frame(spark, d, "change_log"))


def net_changes(spark, d):
    return changelog.net_changes(changelog.changes_since(frame(spark, d, "change_log"), CURSOR))


def advance_cursor(spark, d):
    return changelog.advance_cursor(frame(spark, d, "change_log"), CURSOR)


def is_stale(spark, d):
    return changelog.is_stale(frame(spark, d, "change_log"), CURSOR)


def bootstrap_corpus(spark, d):
    return corpus.bootstrap(frame(spark, d, "manifest"), _old_chunks(spark, d))


def apply_delta(spark, d):
    base = corpus.bootstrap(frame(spark, d, "manifest"), _old_chunks(spark, d))
    artifacts = _new_chunks(spark, d).filter(~F.col("doc_id").endswith("9.txt"))
    return corpus.apply_changes(base, frame(spark, d, "doc_changes"), artifacts)


def remove_doc(spark, d):
    return corpus.remove_docs(_old_chunks(spark, d), _deleted(spark, d))


def merge_chunks(spark, d):
    return corpus.merge_chunks(_old_chunks(spark, d), _new_chunks(spark, d).join(changelog.net_changes(frame(spark, d, "doc_changes")).filter("op = 'upsert'"), "doc_id", "left_semi"))


def doc_chunk_index(spark, d):
    return corpus.doc_chunk_index(frame(spark, d, "vector_records").select("doc_id", F.col("key").alias("chunk_id")))


def chunk_to_doc(spark, d):
    return corpus.chunk_to_doc(doc_chunk_index(spark, d))


def chunk_payload(spark, d):
    return corpus.chunk_payload(frame(spark, d, "chunks"))


def chunk_ids(spark, d):
    numbered = corpus.number_chunks(frame(spark, d, "vector_records").select("doc_id", "key"), "key")
    return numbered.select("doc_id", "key", keys.chunk_id(F.col("doc_id"), F.col("ordinal") + 9_990).alias("chunk_id"))


def embed_chunks(spark, d):
    records = embedding.vector_records(embedding.embed_chunks(frame(spark, d, "chunks")))
    return records.select("key", F.col("metadata")["doc_id"].alias("doc_id"), F.col("data.float32").alias("embedding"))


def load_snapshot(spark, d):
    return snapshot.load(frame(spark, d, "snapshot_rows"))


def publish_snapshot(spark, d):
    return snapshot.documents(_old_chunks(spark, d)).select("id", "page_content", F.col("metadata.doc_id").alias("doc_id"), F.col("metadata.chunk_id").alias("chunk_id"))


def snapshot_stats(spark, d):
    valid = _valid(spark, d)
    target = valid.agg(F.max("corpus_version")).first()[0] or 0
    n = events.coalesce_events(valid).count()
    cursor = changelog.latest_change_id(frame(spark, d, "change_log")).first()[0]
    return snapshot.stats(bootstrap_corpus(spark, d), n, target, cursor)


def _pointers(spark, d):
    return frame(spark, d, "change_log").filter("change_id % 50 = 0").select(F.col("change_id").alias("corpus_version"), F.concat(F.lit("bm25/v"), F.col("change_id").cast("string")).alias("key"))


def read_pointer(spark, d):
    return snapshot.latest_pointer(_pointers(spark, d))


def rebuild_needed(spark, d):
    return events.target_version(_valid(spark, d)).crossJoin(F.broadcast(read_pointer(spark, d))).select(snapshot.rebuild_needed(F.col("corpus_version"), F.col("target_version")).alias("rebuild_needed"))


def rebuild_guard(spark, d):
    pointers = _pointers(spark, d)
    since = changelog.changes_since(frame(spark, d, "change_log"), CURSOR)
    # Below 200 as if the log held unknown operations alone, which come to nothing.
    n = changelog.net_changes(since).agg(F.count("*").alias("n")).crossJoin(changelog.net_changes(since.filter("op = 'noop'")).agg(F.count("*").alias("none")))
    changes = F.when(F.col("corpus_version") < 200, F.col("none")).otherwise(F.col("n"))
    return pointers.crossJoin(F.broadcast(n)).select("corpus_version", snapshot.rebuild_guard(F.col("corpus_version"), F.lit(CURSOR), changes).alias("decision"))


def validate_publish_event(spark, d):
    rows = frame(spark, d, "index_events").withColumn("payload", F.try_parse_json("body"))
    return events.publishable(rows).select("message_id", "publishable")


def validate_created_events(spark, d):
    return events.validate_object_events(frame(spark, d, "object_events"), events.CREATED)


def validate_removed_events(spark, d):
    return events.validate_object_events(frame(spark, d, "object_events"), events.REMOVED, BUCKET)


def normalize_index_events(spark, d):
    return events.normalize_index_events(frame(spark, d, "index_events"))


def coalesce_events(spark, d):
    return events.coalesce_events(_valid(spark, d))


def target_version(spark, d):
    return events.target_version(_valid(spark, d))


def batch_failures(spark, d):
    return events.batch_failures(events.normalize_index_events(frame(spark, d, "index_events")), F.lit(True))


def manifest_fold(spark, d):
    return manifest.fold(frame(spark, d, "manifest_actions"))


def claim_outcomes(spark, d):
    return manifest.outcomes(frame(spark, d, "manifest_actions"))


def validate_chat(spark, d):
    return search.validate_chat(frame(spark, d, "chat_requests"))


def tokenize_overlap(spark, d):
    return _docs(spark, d).select("doc_id", F.sort_array(text.overlap_tokens(F.col("text"))).alias("tokens"))


def tokenize_ws(spark, d):
    return _docs(spark, d).select("doc_id", text.ws_tokens(F.col("text")).alias("tokens"))


def normalize_whitespace(spark, d):
    return _docs(spark, d).select("doc_id", text.normalize_whitespace(F.concat(F.lit("  "), F.col("text"), F.lit(" \t"))).alias("text"))


def snippet(spark, d):
    return _docs(spark, d).select("doc_id", text.snippet(F.col("text"), F.lit("Sh enti, or X the")).alias("hit"), text.snippet(F.col("text"), F.lit("zzzz q")).alias("no_hit"))


def decode_keys(spark, d):
    rows = frame(spark, d, "raw_objects").select("key", F.concat(F.replace("key", F.lit("doc-"), F.lit("doc+%28")), F.lit("%29%C3%A9")).alias("raw"))
    return rows.select("key", keys.decode_key(F.col("raw")).alias("decoded"), keys.decode_key(F.concat("key", F.lit("+%zz"))).alias("kept"))


def doc_name(spark, d):
    return frame(spark, d, "raw_objects").select("key", keys.doc_name(F.regexp_replace("key", "-", ".v1-")).alias("name"))


def chunk_key(spark, d):
    return frame(spark, d, "raw_objects").select("key", keys.chunk_file_key(F.col("key")).alias("chunk_key"))


def bm25_doc_stats(spark, d):
    return _corpus(spark, d)[1].docs().select("doc_id", "chunk_ord", "dl")


def bm25_term_stats(spark, d):
    return bm25.index_term_stats(_corpus(spark, d)[1]).withColumn("idf", F.round("idf", 6))


def bm25_topk(spark, d):
    chunks, index = _corpus(spark, d)
    return bm25.top_k(chunks, _queries(spark, d), search.candidates_for(search.ANSWERS), index)


def rerank_overlap(spark, d):
    chunks, index = _corpus(spark, d)
    return search.search(chunks, _queries(spark, d), index=index)


def rerank_empty_tokens(spark, d):
    chunks, index = _corpus(spark, d)
    return search.rerank(bm25.top_k(chunks, _queries(spark, d), 20, index), chunks, _odd_queries(spark, d))


def chat_answer(spark, d):
    chunks, index = _corpus(spark, d)
    return search.answers(chunks, _queries(spark, d), index=index)


def sentence_distances(spark, d):
    return chunking.distances(dealt(_docs(spark, d)))


def chunk_breakpoints(spark, d):
    return chunking.breakpoints(dealt(_docs(spark, d)))


def semantic_chunks(spark, d):
    return chunking.semantic_chunks(dealt(_docs(spark, d)))


def semantic_search(spark, d):
    chunks, index = _corpus(spark, d, semantic=True)
    return search.search(chunks, _queries(spark, d), index=index)


def _worker(spark, d):
    """A worker over an empty store; every 13th document's object is missing."""
    root = shared_folder(spark, "corpus")
    objects = dealt(frame(spark, d, "raw_objects")).filter(F.regexp_extract("key", "([0-9]+)", 1).cast("long") % 13 != 0).select(F.col("key").alias("doc_id"), F.encode("text", "utf-8").alias("content"))
    queues = workers.Queues(f"{root}/queue/retry", f"{root}/dead", f"{root}/refused", f"{root}/index")
    return workers.Worker(store.Store(spark, f"{root}/store"), queues, lambda s: objects, BUCKET)


def _manifest_rows(rows, vector_keys):
    none = F.lit(None).cast("string")
    return rows.select("doc_id", F.lit(BUCKET).alias("bucket_name"), "status", F.lit("before").alias("req_id"), vector_keys.alias("vector_keys"), none.alias("error_message"))


def ingest_batch(spark, d):
    """Every document's created event in one batch, over a manifest that knows a third of the documents: what the store holds then."""
    w = _worker(spark, d)
    before = _manifest_rows(frame(spark, d, "manifest_before"), F.array().cast("array<string>"))
    w.store.commit(lambda now: store.Written(now, {"manifest": w.store.replace("manifest", now, before.select("doc_id"), before)}))
    w.ingestion()(frame(spark, d, "created_messages"), 0)
    chunks = w.store.read("chunks").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("chunk_chars"), F.max("chunk_id").alias("last_chunk"))
    batches = w.store.read("vectors").groupBy("doc_id").agg((F.max("batch_no") + 1).alias("n_batches"), F.sum(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)).cast("long").alias("n_words"))
    rows = w.store.read("manifest").join(chunks, "doc_id", "left").join(batches, "doc_id", "left").join(w.store.changes().select("doc_id", "change_id", "op"), "doc_id", "left")
    return rows.select("doc_id", "status", "req_id", "error_message", F.size("vector_keys").alias("n_keys"), "n_chunks", "chunk_chars", "last_chunk", "n_batches", "n_words", "change_id", "op")


def delete_batch(spark, d):
    """Removed events of two thirds of the documents in one batch: what the store holds then."""
    w = _worker(spark, d)
    full = frame(spark, d, "manifest_full")
    there = F.col("status") != "deleted"
    before = _manifest_rows(full, F.when(there, F.array("chunk_id")).otherwise(F.array().cast("array<string>")))
    chunks = frame(spark, d, "chunks").join(full.filter(there).select("doc_id"), "doc_id", "left_semi")
    records = full.filter(there).select("doc_id", F.col("chunk_id").alias("key"), F.lit(0).cast("long").alias("batch_no"), F.array(F.col("n_chars").cast("float")).alias("embedding"))
    put = lambda now, table, rows: w.store.replace(table, now, rows.select("doc_id"), rows)
    w.store.commit(lambda now: store.Written(now, {t: put(now, t, r) for t, r in (("manifest", before), ("chunks", chunks), ("vectors", records))}))
    w.deletion()(frame(spark, d, "removed_messages"), 0)
    n_chunks = w.store.read("chunks").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("chunk_chars"))
    n_vectors = w.store.read("vectors").groupBy("doc_id").agg(F.count("*").alias("n_vectors"))
    rows = w.store.read("manifest").join(n_chunks, "doc_id", "left").join(n_vectors, "doc_id", "left").join(w.store.changes().select("doc_id", "change_id", "op"), "doc_id", "left")
    return rows.select("doc_id", "status", "req_id", "vector_keys", "n_chunks", "chunk_chars", "n_vectors", "change_id", "op")


NAMES = (
    "upload_plan list_documents delete_raw_document extract_text_route decode_utf8_replace chunks_to_jsonl load_chunks delete_chunks vector_batches vector_batch_summary "
    "delete_vectors vector_topk indexed_doc_ids append_change_log changes_since latest_change_id net_changes advance_cursor is_stale bootstrap_corpus apply_delta remove_doc "
    "merge_chunks doc_chunk_index chunk_to_doc chunk_payload chunk_ids embed_chunks load_snapshot publish_snapshot snapshot_stats read_pointer rebuild_needed rebuild_guard "
    "validate_publish_event validate_created_events validate_removed_events normalize_index_events coalesce_events target_version batch_failures manifest_fold claim_outcomes "
    "validate_chat tokenize_overlap tokenize_ws normalize_whitespace snippet decode_keys doc_name chunk_key bm25_doc_stats bm25_term_stats bm25_topk rerank_overlap "
    "rerank_empty_tokens chat_answer sentence_distances chunk_breakpoints semantic_chunks semantic_search ingest_batch delete_batch"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
