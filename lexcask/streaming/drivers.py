"""Structured Streaming drivers: object events to actions, index events to snapshots, retries and dead letters."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changelog, corpus, events
from ..sources import lake

log_ = logging.getLogger(__name__)

# Deliveries before a message is dead, messages of a batch, its longest wait.
MAX_RECEIVES = 5
BATCH_FILES = 10
WAIT = "20 seconds"

MESSAGES = "message_id string, arrival_seq long, body string, attempts int"


def messages(spark: SparkSession, path: str, files_per_batch: int = BATCH_FILES) -> DataFrame:
    """A queue as a folder of JSON lines, with all below it: what is delivered again is read like what is new.

    The checkpoint takes the place of visibility timeouts.
    """
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").json(path)


def run(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``body`` for each micro-batch: what is there now, or every 20 seconds."""
    writer = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=WAIT)).start()


def redrive(failed: DataFrame, retry: str, dead: str, batch_id: int | str, error: str | Column) -> None:
    """Failed messages go back with one more attempt and the error; those at the limit go to the dead-letter folder.

    Each batch has a folder of its own, overwritten if it is run again, so that no message is retried twice for one fault.
    """
    said = error if isinstance(error, Column) else F.lit(error)
    again = failed.select("message_id", "arrival_seq", "body", (F.coalesce("attempts", F.lit(0)) + 1).alias("attempts"), said.alias("error")).persist()
    again.filter(F.col("attempts") < MAX_RECEIVES).write.mode("overwrite").json(f"{retry}/batch={batch_id}")
    again.filter(F.col("attempts") >= MAX_RECEIVES).write.mode("overwrite").json(f"{dead}/batch={batch_id}")
    again.unpersist()


def object_event_batch(kind: str, out: str, bucket: str | None = None) -> Callable[[DataFrame, int], None]:
    """Object events of each batch to folders of the batch's own: accepted ones once for each document, refused ones with the reason below ``_refused``."""

    def body(batch: DataFrame, batch_id: int) -> None:
        seen = events.validate_object_events(batch, kind, bucket)
        seen.filter("reject_reason IS NOT NULL").write.mode("overwrite").parquet(f"{out}/_refused/batch={batch_id}")
        rows = seen.filter("reject_reason IS NULL")
        # A folder for each batch, overwritten if it is run again: at-least-once becomes exactly-once.
        rows.dropDuplicates(["message_id", "doc_id"]).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return body


def snapshot_batch(root: str, log_path: str, artifacts_path: str, manifest_path: str, retry: str, dead: str) -> Callable[[DataFrame, int], None]:
    """Brings the snapshot up to the batch's target: guard, baseline, changes, publish, pointer.

    A batch whose target is behind the pointer is done already.  If the changes it
    names are not in the log yet, or anything fails, its valid messages are
    delivered again; malformed ones never are.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        normal = events.normalize_index_events(batch).persist()
        try:
            valid = normal.filter("valid")
            target = events.target_version(valid).first()[0]
            if target is None:
                return
            base, version = lake.read_snapshot(spark, root)
            if version >= target:
                return
            log = spark.read.parquet(log_path)
            # A fixed upper bound: the published version covers exactly what was read.
            bound = changelog.latest_change_id(log).first()[0]
            changes = changelog.changes_since(log, version).filter(F.col("change_id") <= bound)
            artifacts = spark.read.parquet(artifacts_path)
            if base is None:
                base = corpus.bootstrap(spark.read.parquet(manifest_path), artifacts)
            if not changelog.net_changes(changes).limit(1).count():
                raise RuntimeError("the change log is behind the events")
            lake.publish_snapshot(corpus.apply_changes(base, changes, artifacts), root, max(target, bound), events.coalesce_events(valid).count())
        except Exception as e:
            log_.exception("batch %s is delivered again", batch_id)
            ids = events.batch_failures(normal, F.lit(True)).select(F.col("itemIdentifier").alias("message_id"))
            redrive(batch.join(ids, "message_id", "left_semi"), retry, dead, batch_id, f"{type(e).__name__}: {e}"[:2000])
        finally:
            normal.unpersist()

    return body


def refresh(corpus_rows: DataFrame, log: DataFrame, artifacts: DataFrame, cursor: int) -> tuple[DataFrame, int]:
    """The corpus after the changes since a cursor, and the cursor then; unchanged if nothing is new."""
    if not changelog.is_stale(log, cursor).first()[0]:
        return corpus_rows, cursor
    after = changelog.advance_cursor(log, cursor).first()[0]
    changes = changelog.changes_since(log, cursor).filter(F.col("change_id") <= after)
    return corpus.apply_changes(corpus_rows, changes, artifacts), after
