"""Redelivery in event time: a message that is not settled comes back until it is dead.

The stream holds two kinds of rows for a message: that it was sent, and that it was done.
A sent message is delivered at once; if it is not done when its visibility ends it is
delivered again, at the fifth end it is dead, and after the queue's retention it is
dropped.  The watermark is the clock, so a rerun over the same files delivers the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .drivers import MAX_RECEIVES
from .manifest import ROCKSDB

# Fixed values, in seconds: how long a delivered message is hidden, how long a queue and dead letters keep theirs.
VISIBILITY, RETENTION, DEAD_RETENTION = 360, 345_600, 1_209_600
SENT, DONE = "sent", "done"
OUTPUT = "message_id string, body string, receives int, event string, at timestamp"


class Deliver(StatefulProcessor):
    """State of a message: its body, when it was sent, how often it was delivered; one timer, for what comes next."""

    def __init__(self, visibility: int, retention: int, dead_retention: int, most: int):
        self.visibility, self.retention, self.dead_retention, self.most = visibility * 1000, retention * 1000, dead_retention * 1000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("message", "body string, sent bigint, receives int, settled boolean")

    def _row(self, key: Any, body: str | None, receives: int, event: str, at: int) -> Row:
        from datetime import datetime, timezone

        return Row(message_id=key[0], body=body, receives=receives, event=event, at=datetime.fromtimestamp(at / 1000, timezone.utc))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        sent, done = None, None  # the first of each kind; a batch's rows come in no order
        for r in rows:
            at = int(r["at"].timestamp() * 1000)
            if r["kind"] == SENT and (sent is None or at < sent[1]):
                sent = (r["body"], at)
            elif r["kind"] == DONE and (done is None or at < done):
                done = at
        new = not self.held.exists()
        if new and sent is not None:
            self.held.update((sent[0], sent[1], 1, False))
            yield self._row(key, sent[0], 1, "delivered", sent[1])
        elif new:
            return  # settled without having been seen, or long gone
        body, first, receives, settled = self.held.get()
        if done is not None and not settled:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            # Remembered until the queue would have dropped it, so that a copy is not delivered anew.
            self.held.update((body, first, receives, True))
            self.handle.registerTimer(first + self.retention)
            yield self._row(key, body, receives, "settled", done)
        elif new:
            self.handle.registerTimer(min(first + self.visibility, first + self.retention))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        body, first, receives, settled = self.held.get()
        if settled:
            self.held.clear()
        elif receives > self.most:  # a dead letter's time is over
            self.held.clear()
            yield self._row(key, body, self.most, "dead letter dropped", at)
        elif at >= first + self.retention:
            self.held.clear()
            yield self._row(key, body, receives, "expired", at)
        elif receives == self.most:
            self.held.update((body, first, receives + 1, False))
            self.handle.registerTimer(at + self.dead_retention)
            yield self._row(key, body, receives, "dead", at)
        else:
            self.held.update((body, first, receives + 1, False))
            self.handle.registerTimer(min(at + self.visibility, first + self.retention))
            yield self._row(key, body, receives + 1, "delivered", at)

    def close(self) -> None:
        pass


def deliveries(rows: DataFrame, late: str = "10 minutes", visibility: int = VISIBILITY, retention: int = RETENTION, dead_retention: int = DEAD_RETENTION, most: int = MAX_RECEIVES) -> DataFrame:
    """message_id, body, receives, event, at of a stream (message_id, kind, at, body): delivered, settled, dead, expired.

    Rows later than ``late`` behind the newest are dropped.  A message that is sent again while it is known is one message.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = rows.filter(F.col("message_id").isNotNull() & F.col("at").isNotNull()).withWatermark("at", late)
    processor = Deliver(visibility, retention, dead_retention, most)
    return timed.groupBy("message_id").transformWithState(statefulProcessor=processor, outputStructType=OUTPUT, outputMode="append", timeMode="EventTime")
