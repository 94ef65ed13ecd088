import json

from pyspark.sql import functions as F

from lexcask.operators import manifest
from lexcask.sources import lake
from lexcask.sources.fixtures import frame
from lexcask.streaming import drivers
from lexcask.streaming.manifest import fold_stream

CHUNKS = "doc_id string, chunk_id string, text string"


def write_lines(path, name, rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_streamed_fold_equals_batch_fold(spark, sf, tmp_path):
    actions = frame(spark, sf, "manifest_actions")
    src = f"{tmp_path}/src"
    (tmp_path / "src").mkdir()
    bound = actions.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY seq)")).first()[0]
    stream = spark.readStream.schema(actions.schema).parquet(src)
    for part in (actions.filter(F.col("seq") <= bound), actions.filter(F.col("seq") > bound)):
        part.coalesce(1).write.mode("append").parquet(src)
        fold_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "seq", "action", "outcome")
    want = manifest.outcomes(actions)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_object_events_stream(spark, tmp_path):
    body = json.dumps({"Records": [{"eventName": "ObjectCreated:Put", "s3": {"bucket": {"name": "b"}, "object": {"key": "raws/a.txt"}}}]})
    write_lines(tmp_path / "q", "1.json", [{"message_id": "m1", "body": body}, {"message_id": "m2", "body": "{bad"}])
    q = drivers.run(drivers.messages(spark, f"{tmp_path}/q"), drivers.object_event_batch("ObjectCreated:", f"{tmp_path}/out"), f"{tmp_path}/cp")
    q.awaitTermination()
    assert [r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["raws/a.txt"]
    assert [(r.message_id, r.reject_reason) for r in spark.read.parquet(f"{tmp_path}/out/_refused").collect()] == [("m2", "invalid json body")]


def test_snapshot_stream_publishes_restarts_and_redrives(spark, tmp_path):
    spark.createDataFrame([("d1", "d1_1", "new"), ("d2", "d2_1", "two")], CHUNKS).write.parquet(f"{tmp_path}/art")
    spark.createDataFrame([("d2", "indexed")], "doc_id string, status string").write.parquet(f"{tmp_path}/man")
    spark.createDataFrame([(1, "d1", "upsert")], "change_id long, doc_id string, op string").write.parquet(f"{tmp_path}/log")
    body = drivers.snapshot_batch(f"{tmp_path}/snap", f"{tmp_path}/log", f"{tmp_path}/art", f"{tmp_path}/man", f"{tmp_path}/retry", f"{tmp_path}/dead")

    def go():
        drivers.run(drivers.messages(spark, f"{tmp_path}/q"), body, f"{tmp_path}/cp").awaitTermination()

    def event(mid, version, attempts=None):
        return {"message_id": mid, "arrival_seq": version, "attempts": attempts, "body": json.dumps({"doc_id": "d1", "op": "upsert", "corpus_version": version})}

    write_lines(tmp_path / "q", "1.json", [event("m1", 1), {"message_id": "m2", "body": "{bad"}])
    go()
    chunks, version = lake.read_snapshot(spark, f"{tmp_path}/snap")
    assert version == 1 and {r.doc_id for r in chunks.collect()} == {"d1", "d2"}
    # Restarted from its checkpoint: an old target changes nothing.
    write_lines(tmp_path / "q", "2.json", [event("m3", 1)])
    go()
    assert lake.read_snapshot(spark, f"{tmp_path}/snap")[1] == 1
    # A target without changes is delivered again, the fifth time to the dead letters.
    write_lines(tmp_path / "q", "3.json", [event("m4", 9), event("m5", 9, 4), {"message_id": "m6", "body": "[]"}])
    go()
    again = spark.read.json(f"{tmp_path}/retry").collect()
    assert [(r.message_id, r.attempts) for r in again] == [("m4", 1)] and "behind" in again[0].error
    assert [r.message_id for r in spark.read.json(f"{tmp_path}/dead").collect()] == ["m5"]


def test_refresh(spark):
    base = spark.createDataFrame([("d1", "d1_1", "old")], CHUNKS)
    log = spark.createDataFrame([(1, "d1", "delete"), (2, "d2", "upsert")], "change_id long, doc_id string, op string")
    art = spark.createDataFrame([("d2", "d2_1", "x")], CHUNKS)
    out, cursor = drivers.refresh(base, log, art, 0)
    assert cursor == 2 and [r.doc_id for r in out.collect()] == ["d2"]
    assert drivers.refresh(out, log, art, 2) == (out, 2)


def test_hot_document_is_folded_in_order_over_restarts(spark, tmp_path):
    n = 4000
    ops = ["claim_ingest", "fail_ingest", "claim_ingest", "finalize_ingest", "claim_delete", "finalize_delete", "fail_delete", "noop"]
    rows = [("hot" if i % 3 else f"d{i % 5}", i, ops[(i * 7 + i // 11) % 8], f"r{i % 2}") for i in range(n)]
    actions = spark.createDataFrame(rows, "doc_id string, seq long, action string, req_id string")
    (tmp_path / "src").mkdir()
    stream = spark.readStream.schema(actions.schema).parquet(f"{tmp_path}/src")
    for lo, hi in ((0, 1500), (1500, 1501), (1501, n)):
        # Many files in no order; each start takes up the state where the last one left it.
        actions.filter(f"seq >= {lo} AND seq < {hi}").repartition(7).write.mode("append").parquet(f"{tmp_path}/src")
        fold_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "seq", "action", "outcome")
    want = manifest.outcomes(actions)
    assert got.count() == n and got.exceptAll(want).count() == 0


def test_messages_come_back_until_they_are_dead(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    from lexcask.streaming import redelivery

    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    schema = "message_id string, kind string, at timestamp, body string"
    (tmp_path / "src").mkdir()
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/src")
    events = []

    def push(*rows):
        # (message, kind, seconds); "tick" moves the clock.
        lines = [{"message_id": m, "kind": k, "at": (start + timedelta(seconds=s)).isoformat(), "body": f"b-{m}"} for m, k, s in rows]
        write_lines(tmp_path / "src", f"{len(events)}.json", lines)
        out = redelivery.deliveries(stream, "0 seconds", retention=4000, dead_retention=6000)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        events.append(1)

    push(("stuck", "sent", 0), ("fine", "sent", 0), ("slow", "sent", 1), ("never", "done", 2))
    push(("fine", "done", 100), ("tick1", "sent", 361))
    for k in range(2, 7):
        push((f"tick{k}", "sent", 361 * k + 5), *([("slow", "done", 361 * k)] if k == 3 else []))
    push(("stuck", "sent", 20), ("fine", "sent", 400))  # behind the watermark: dropped
    push(("end", "sent", 20_000))
    seen = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("at").collect():
        seen.setdefault(r.message_id, []).append((r.event, r.receives))
        assert r.body == f"b-{r.message_id}"
    assert seen["stuck"] == [("delivered", i) for i in range(1, 6)] + [("dead", 5), ("dead letter dropped", 5)]
    assert seen["fine"] == [("delivered", 1), ("settled", 1)] and "never" not in seen
    assert seen["slow"][0] == ("delivered", 1) and seen["slow"][-1][0] == "settled" and 2 <= len(seen["slow"]) <= 5
