"""The ingestion and the deletion worker: each micro-batch is one transaction over chunks, vectors, manifest and change log.

Files are written first, one commit names them, then the index events go out and failed
messages go back.  A batch that is run again after a crash finds itself in the log and
only sends what goes out, into folders named by its number, or is done from the start,
on a state that knows nothing of the first try.  A document that fails keeps its error
in the manifest and its message is delivered again; the others of its batch are done.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, embedding, events, manifest, vectors
from ..sources import lake
from ..sources.store import State, Store, Written
from . import drivers

#: What a document's error says.
NO_OBJECT, NO_TEXT, NO_CHUNKS = "no such object", "document text extraction failed", "chunking produced no output"


@dataclass(frozen=True)
class Queues:
    """Folders: messages to deliver again, dead ones, refused events, index events."""

    retry: str
    dead: str
    refused: str
    index_events: str


@dataclass(frozen=True)
class Worker:
    """What both workers share; ``objects`` gives the raw objects (doc_id, content) and is asked anew for each batch."""

    store: Store
    queues: Queues
    objects: Callable[[SparkSession], DataFrame] | None = None
    bucket: str | None = None
    embed: Callable[[Column], Column] = embedding.hashed_counts
    pdf: Callable[[bytes], list[str | None]] | None = None
    #: Called between a batch's steps with the name of the next one.
    step: Callable[[str], None] = field(default=lambda name: None)

    def ingestion(self, stream: str = "ingest") -> Callable[[DataFrame, int], None]:
        """The body of a stream of created events (message_id, arrival_seq, body, attempts)."""
        return lambda batch, batch_id: self._run(batch, batch_id, stream, events.CREATED, None, self._ingest)

    def deletion(self, stream: str = "delete") -> Callable[[DataFrame, int], None]:
        """The body of a stream of removed events; those of other buckets are refused."""
        return lambda batch, batch_id: self._run(batch, batch_id, stream, events.REMOVED, self.bucket, self._delete)

    def _run(self, batch: DataFrame, batch_id: int, stream: str, kind: str, bucket: str | None, write: Callable[[DataFrame, State, str], Written]) -> None:
        seen = events.validate_object_events(batch, kind, bucket)
        seen.filter("reject_reason IS NOT NULL").write.mode("overwrite").json(f"{self.queues.refused}/{stream}-{batch_id}")
        accepted = seen.filter("reject_reason IS NULL").select("message_id", "bucket", "doc_id")
        # The first message of a document claims it; others of the batch find it claimed.
        first = accepted.join(batch.select("message_id", "arrival_seq"), "message_id").groupBy("doc_id").agg(F.min_by("bucket", F.struct("arrival_seq", "message_id")).alias("bucket_name"))
        self.store.commit(lambda now: write(first, now, f"{stream}-{batch_id}"), stream, batch_id)
        done = self.store.state(self.store.state().streams[stream][1])
        self.step("publish")
        self._publish(done, f"{stream}-{batch_id}")
        self.step("redrive")
        failed = self.store.written_by("manifest", done).filter((F.col("status") == manifest.INGEST_FAILED) & (F.col("req_id") == f"{stream}-{batch_id}"))
        again = accepted.join(failed.select("doc_id", "error_message"), "doc_id").groupBy("message_id").agg(F.min("error_message").alias("why"))
        drivers.redrive(batch.join(again, "message_id"), self.queues.retry, self.queues.dead, f"{stream}-{batch_id}", F.col("why"))

    def _claims(self, docs: DataFrame, now: State, action: str, request: str) -> DataFrame:
        """docs with their manifest rows and the outcome of a claim; written, so that it is decided once."""
        touched = [r[0] for r in docs.select(self.store.bucket(F.col("doc_id"))).distinct().collect()]
        rows = docs.join(self.store.read("manifest", now, touched).select("doc_id", "status", F.col("req_id").alias("held"), "vector_keys"), "doc_id", "left")
        _, _, outcome = manifest.step(F.col("status"), F.col("held"), F.lit(action), F.lit(request))
        return self._written(rows.select("doc_id", "bucket_name", "vector_keys", outcome.alias("outcome")), "claims")

    def _written(self, rows: DataFrame, what: str) -> DataFrame:
        """The rows from files: what two sinks read is made once."""
        self.step(what)
        folder = self.store.folder("work")
        rows.write.parquet(folder)
        return rows.sparkSession.read.schema(rows.schema).parquet(folder)

    def _ingest(self, docs: DataFrame, now: State, request: str) -> Written:
        spark, store = docs.sparkSession, self.store
        work = self._claims(docs, now, "claim_ingest", request).filter(F.col("outcome").isin("claimed", "reclaimed"))
        found = self.objects(spark).select("doc_id", "content").join(work.select("doc_id"), "doc_id", "left_semi")
        texts = self._written(lake.extract_text(found, self.pdf), "texts")
        readable = texts.filter("error IS NULL AND text <> ''").select("doc_id", "text")
        chunks = self._written(chunking.semantic_chunks(readable), "cut")
        embedded = embedding.embed_chunks(chunks, self.embed)
        records = self._written(embedded.join(vectors.batches(embedded.select("doc_id", "key")), ["doc_id", "key"]), "embed")
        keys = records.groupBy("doc_id").agg(F.array_sort(F.collect_list("key")).alias("vector_keys"))
        error = (
            F.when(F.col("t.doc_id").isNull(), F.lit(NO_OBJECT))
            .when(F.col("error").isNotNull(), F.col("error"))
            .when(F.coalesce("text", F.lit("")) == "", F.lit(NO_TEXT))
            .when(F.col("k.vector_keys").isNull(), F.lit(NO_CHUNKS))
        )
        joined = work.alias("w").join(texts.alias("t"), "doc_id", "left").join(keys.alias("k"), "doc_id", "left").withColumn("error_message", error)
        good = F.col("error_message").isNull()
        none = F.array().cast("array<string>")
        rows = self._written(
            joined.select(
                "doc_id",
                "bucket_name",
                F.when(good, manifest.INDEXED).otherwise(manifest.INGEST_FAILED).alias("status"),
                F.lit(request).alias("req_id"),
                F.when(good, F.col("k.vector_keys")).otherwise(F.coalesce("w.vector_keys", none)).alias("vector_keys"),
                "error_message",
            ),
            "rows",
        )
        indexed = rows.filter(F.col("status") == manifest.INDEXED).select("doc_id")
        tables = {}
        for table, new in (("chunks", chunks), ("vectors", records)):
            self.step(table)
            tables[table] = store.replace(table, now, indexed, new)
        return self._finish(tables, rows, indexed, now, "upsert")

    def _delete(self, docs: DataFrame, now: State, request: str) -> Written:
        store = self.store
        work = self._claims(docs, now, "claim_delete", request).filter(F.col("outcome") == "deleting")
        self.step("chunks")
        tables = {"chunks": store.replace("chunks", now, work.filter(F.size("vector_keys") > 0))}
        self.step("vectors")
        # The keys are those of the claimed rows; a document's vectors lie in its bucket.
        tables["vectors"] = store.replace("vectors", now, work.select("doc_id", F.explode("vector_keys").alias("key")), on="key")
        rows = work.select("doc_id", "bucket_name", F.lit(manifest.DELETED).alias("status"), F.lit(request).alias("req_id"), F.array().cast("array<string>").alias("vector_keys"), F.lit(None).cast("string").alias("error_message"))
        return self._finish(tables, rows, work.select("doc_id"), now, "delete")

    def _finish(self, tables: dict, rows: DataFrame, changed: DataFrame, now: State, op: str) -> Written:
        self.step("manifest")
        tables["manifest"] = self.store.replace("manifest", now, rows.select("doc_id"), rows)
        self.step("changes")
        folder, n = self.store.write_changes(changed.select("doc_id", F.lit(op).alias("op")))
        self.step("commit")
        return Written(now, tables, folder, n)

    def _publish(self, done: State, request: str) -> None:
        """The batch's changes as messages of the index queue, in a folder of the batch's own."""
        body = F.to_json(F.struct("doc_id", "op", F.col("change_id").alias("corpus_version")))
        rows = self.store.changes_of(done).select(F.concat(F.lit("change-"), F.col("change_id").cast("string")).alias("message_id"), F.col("change_id").alias("arrival_seq"), body.alias("body"), F.lit(0).alias("attempts"))
        rows.write.mode("overwrite").json(f"{self.queues.index_events}/{request}")
