"""The manifest: each document's life as a state machine, folded over its actions.

One shuffle brings a document's actions together in order; a task then passes over its
rows once and holds nothing but the state it is in, so a document may have any number
of actions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states.
INGESTING, INDEXED, INGEST_FAILED = "ingesting", "indexed", "ingest failed"
DELETING, DELETED, DELETE_FAILED = "deleting", "deleted", "delete failed"


def step(status: Column, req: Column, action: Column, own: Column) -> tuple[Column, Column, Column]:
    """(status, req_id, outcome) after one action; a null status is a document without a row."""
    held = req == own
    # (action and its precondition, next status, whether the request takes over, outcome)
    moves = [
        ((action == "claim_ingest") & status.isNull(), INGESTING, True, "claimed"),
        ((action == "claim_ingest") & (status == INGEST_FAILED), INGESTING, True, "reclaimed"),
        ((action == "claim_ingest"), None, False, "skipped ingestion"),
        ((action == "finalize_ingest") & (status == INGESTING) & held, INDEXED, False, "indexed"),
        ((action == "fail_ingest") & status.isNotNull(), INGEST_FAILED, False, "ingest failed"),
        ((action == "fail_delete") & status.isNotNull(), DELETE_FAILED, False, "delete failed"),
        ((action == "claim_delete") & status.isin(INDEXED, DELETE_FAILED), DELETING, True, "deleting"),
        ((action == "claim_delete"), None, False, "skipped deletion"),
        ((action == "finalize_delete") & (status == DELETING) & held, DELETED, False, "deleted"),
    ]
    new_status, new_req, outcome = status, req, F.lit("guard failed")
    for test, to, takes, says in reversed(moves):
        ok = F.coalesce(test, F.lit(False))
        new_status = F.when(ok, F.lit(to) if to else status).otherwise(new_status)
        new_req = F.when(ok, own if takes else req).otherwise(new_req)
        outcome = F.when(ok, F.lit(says)).otherwise(outcome)
    return new_status, new_req, outcome


def transition(status: str | None, held: str | None, action: str, req: str | None) -> tuple[str | None, str | None, str]:
    """``step`` on plain values."""
    owner = status is not None and held == req
    if action == "claim_ingest":
        if status is None:
            return INGESTING, req, "claimed"
        return (INGESTING, req, "reclaimed") if status == INGEST_FAILED else (status, held, "skipped ingestion")
    if action == "finalize_ingest" and status == INGESTING and owner:
        return INDEXED, held, "indexed"
    if action == "fail_ingest" and status is not None:
        return INGEST_FAILED, held, "ingest failed"
    if action == "fail_delete" and status is not None:
        return DELETE_FAILED, held, "delete failed"
    if action == "claim_delete":
        return (DELETING, req, "deleting") if status in (INDEXED, DELETE_FAILED) else (status, held, "skipped deletion")
    if action == "finalize_delete" and status == DELETING and owner:
        return DELETED, held, "deleted"
    return status, held, "guard failed"


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outcomes of rows sorted by document and place."""
    doc, status, held = object(), None, None
    for b in batches:
        out: list[list] = [[], [], []]
        for d, action, req in zip(*[b.column(c).to_pylist() for c in ("doc_id", "action", "req_id")]):
            if d != doc:
                doc, status, held = d, None, None
            status, held, outcome = transition(status, held, action, req)
            for column, value in zip(out, (outcome, status, held)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("seq"), b.column("action"), *[pa.array(c, pa.string()) for c in out]], names=["doc_id", "seq", "action", "outcome", "status", "req_id"])


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's last row of sorted rows."""
    held = None
    for b in _passing(batches):
        if not b.num_rows:
            continue
        ids = b.column("doc_id").to_pylist()
        if held is not None and held.column("doc_id")[0].as_py() != ids[0]:
            yield held
        ends = [i for i in range(len(ids) - 1) if ids[i] != ids[i + 1]]
        if ends:
            yield b.take(pa.array(ends))
        held = b.slice(len(ids) - 1, 1)
    if held is not None:
        yield held


def _folded(actions: DataFrame, over: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    rows = actions.select("doc_id", F.col("seq").cast("long").alias("seq"), "action", "req_id").repartition("doc_id").sortWithinPartitions("doc_id", "seq", "action", "req_id")
    return rows.mapInArrow(over, "doc_id string, seq long, action string, outcome string, status string, req_id string")


def fold(actions: DataFrame) -> DataFrame:
    """doc_id, status, req_id after all actions (doc_id, seq, action, req_id); documents without a row are left out."""
    return _folded(actions, _last).select("doc_id", "status", "req_id").filter("status IS NOT NULL")


def outcomes(actions: DataFrame) -> DataFrame:
    """doc_id, seq, action, outcome of every action."""
    return _folded(actions, _passing).select("doc_id", "seq", "action", "outcome")
