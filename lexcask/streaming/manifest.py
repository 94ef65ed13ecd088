"""The manifest as a stream: each document's state lies in RocksDB between batches."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.manifest import transition

OUTPUT = "doc_id string, seq long, action string, outcome string, status string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder:
    """Rows of one key and batch in the order of seq, held in a few bytes each: numbers, and each different text once."""

    def __init__(self, rows: Iterator[Row]):
        self.seq, self.action, self.req = array("q"), array("l"), array("l")
        self.names: dict[Any, int] = {}
        for r in rows:
            self.seq.append(r["seq"])
            self.action.append(self.names.setdefault(r["action"], len(self.names)))
            self.req.append(self.names.setdefault(r["req_id"], len(self.names)))

    def __iter__(self) -> Iterator[tuple[int, str, str | None]]:
        import numpy as np

        names = list(self.names)
        for i in np.argsort(np.frombuffer(self.seq, np.int64), kind="stable") if self.seq else ():
            yield self.seq[i], names[self.action[i]], names[self.req[i]]


class Fold(StatefulProcessor):
    """Value state (status, req_id) of a document; outcomes go out one by one as the batch's actions are folded in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("manifest", "status string, req_id string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        status, req_id = self.held.get() if self.held.exists() else (None, None)
        for seq, action, req in InOrder(rows):
            status, req_id, outcome = transition(status, req_id, action, req)
            yield Row(doc_id=key[0], seq=seq, action=action, outcome=outcome, status=status)
        if status is not None:
            self.held.update((status, req_id))

    def close(self) -> None:
        pass


def fold_stream(actions: DataFrame) -> DataFrame:
    """The outcome of every action (doc_id, seq, action, req_id) of a stream, in order within each batch.

    The session's state stores are RocksDB's from here on, so that states need not fit in memory.
    """
    actions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return actions.groupBy("doc_id").transformWithState(statefulProcessor=Fold(), outputStructType=OUTPUT, outputMode="append", timeMode="none")
