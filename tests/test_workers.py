import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from lexcask.sources import store as st
from lexcask.streaming import drivers, workers

OBJECTS = "doc_id string, content binary"


def event(kind, key, bucket="b"):
    return {"eventName": kind, "s3": {"bucket": {"name": bucket}, "object": {"key": key}}}


def message(i, *events, attempts=0):
    return (f"m{i}", i, json.dumps({"Records": list(events)}), attempts)


def queue(spark, rows):
    return spark.createDataFrame(rows, drivers.MESSAGES)


def worker(spark, root, objects=None, step=lambda name: None, buckets=2):
    q = workers.Queues(f"{root}/q/retry", f"{root}/dead", f"{root}/refused", f"{root}/index/new")
    docs = objects if objects is not None else {"raws/a.txt": b"One. Two. Three.", "raws/b.md": b"Other words stand here.", "raws/c.pdf": b"x", "raws/e.txt": b"  \n"}
    rows = spark.createDataFrame(list(docs.items()), OBJECTS)
    return workers.Worker(st.Store(spark, f"{root}/store", buckets), q, lambda s: rows, "b", step=step)


CREATED = [
    message(1, event("ObjectCreated:Put", "raws/a.txt"), event("ObjectCreated:Put", "raws/b.md")),
    message(2, event("ObjectCreated:Put", "raws/c.pdf"), event("ObjectCreated:Put", "raws/none.txt")),
    message(3, event("ObjectCreated:Copy", "raws/a.txt")),
    message(4, event("ObjectRemoved:Delete", "raws/a.txt")),
    message(5, event("ObjectCreated:Put", "raws/e.txt"), attempts=4),
    ("m6", 6, "{bad", 0),
]
REMOVED = [message(7, event("ObjectRemoved:Delete", "raws/a.txt")), message(8, event("ObjectRemoved:Delete", "raws/c.pdf")), message(9, event("ObjectRemoved:Delete", "raws/b.md", "other"))]


def everything(w):
    read = lambda t, *c: sorted(w.store.read(t).select(*c).collect())
    spark = w.store.spark
    lines = lambda p: sorted((r.message_id, r.attempts, r.error) for r in spark.read.schema(drivers.MESSAGES + ", error string").option("recursiveFileLookup", "true").json(p).collect()) if os.path.isdir(p) else []
    return {
        "manifest": read("manifest", "doc_id", "bucket_name", "status", "req_id", "vector_keys", F.coalesce("error_message", F.lit(""))),
        "chunks": read("chunks", "doc_id", "chunk_id", "chunk_ord", "text"),
        "vectors": read("vectors", "doc_id", "key", "batch_no", "embedding"),
        "changes": sorted(w.store.changes().collect()),
        "retry": lines(w.queues.retry),
        "dead": lines(w.queues.dead),
        "index": sorted(spark.read.schema(drivers.MESSAGES).option("recursiveFileLookup", "true").json(w.queues.index_events).select("message_id", "body").collect()),
        "refused": sorted((r.message_id, r.reject_reason) for r in spark.read.schema("message_id string, reject_reason string").option("recursiveFileLookup", "true").json(w.queues.refused).collect()),
    }


def test_ingest_then_delete(spark, tmp_path):
    w = worker(spark, tmp_path)
    w.ingestion()(queue(spark, CREATED), 0)
    got = everything(w)
    by = {r.doc_id: r for r in w.store.read("manifest").collect()}
    assert {d: r.status for d, r in by.items()} == {"raws/a.txt": "indexed", "raws/b.md": "indexed", "raws/c.pdf": "ingest failed", "raws/none.txt": "ingest failed", "raws/e.txt": "ingest failed"}
    assert by["raws/none.txt"].error_message == workers.NO_OBJECT and by["raws/e.txt"].error_message == workers.NO_TEXT and "PDF" in by["raws/c.pdf"].error_message
    assert [tuple(c) for c in got["changes"]] == [(1, "raws/a.txt", "upsert"), (2, "raws/b.md", "upsert")]
    assert {c.doc_id for c in got["chunks"]} == {"raws/a.txt", "raws/b.md"} and by["raws/a.txt"].vector_keys == [v.key for v in got["vectors"] if v.doc_id == "raws/a.txt"]
    assert [(m, a) for m, a, _ in got["retry"]] == [("m2", 1)] and [(m, a) for m, a, _ in got["dead"]] == [("m5", 5)]
    assert got["refused"] == [("m4", "other event"), ("m6", "invalid json body")]
    assert json.loads(got["index"][0].body) == {"doc_id": "raws/a.txt", "op": "upsert", "corpus_version": 1}
    files = lambda t: {b: sorted(os.listdir(f"{f}/bucket={b}")) for b, f in w.store.state().tables[t].items()}
    before = files("chunks")
    # Deletes: c.pdf never was indexed, b.md's event is of another bucket.
    w.deletion()(queue(spark, REMOVED), 0)
    got = everything(w)
    assert {r.doc_id: r.status for r in w.store.read("manifest").collect()}["raws/a.txt"] == "deleted"
    assert {c.doc_id for c in got["chunks"]} == {"raws/b.md"} == {v.doc_id for v in got["vectors"]}
    assert tuple(got["changes"][-1]) == (3, "raws/a.txt", "delete") and len(got["changes"]) == 3
    kept = files("chunks")
    assert kept and all(before[b] == names for b, names in kept.items())  # untouched files keep their names
    # Delivered again: a failed document is reclaimed, an indexed one skipped, a deleted one skipped.
    later = worker(spark, tmp_path, {"raws/none.txt": b"Now it is there.", "raws/a.txt": b"new", "raws/b.md": b"new"})
    later.ingestion()(queue(spark, [message(2, event("ObjectCreated:Put", "raws/none.txt"), attempts=1), message(10, event("ObjectCreated:Put", "raws/a.txt"), event("ObjectCreated:Put", "raws/b.md"))]), 1)
    assert [tuple(c) for c in later.store.changes(3).collect()] == [(4, "raws/none.txt", "upsert")]
    assert {r.doc_id: r.text for r in later.store.read("chunks").collect()} == {"raws/b.md": "Other words stand here.", "raws/none.txt": "Now it is there."}


STEPS = ["claims", "texts", "cut", "embed", "rows", "chunks", "vectors", "manifest", "changes", "commit", "publish", "redrive"]


def test_killed_between_any_two_steps_and_run_again_leaves_everything_once(spark, tmp_path):
    seen = []
    whole = worker(spark, tmp_path / "whole", step=seen.append)
    whole.ingestion()(queue(spark, CREATED), 0)
    whole.deletion()(queue(spark, REMOVED), 0)
    assert seen[: len(STEPS)] == STEPS
    want = everything(whole)

    class Killed(Exception):
        pass

    left = list(STEPS)

    def once(name):
        if left and name == left[0]:
            left.pop(0)
            raise Killed(name)

    w = worker(spark, tmp_path / "killed", step=once)
    for body, rows in ((w.ingestion(), CREATED), (w.deletion(), REMOVED)):
        left[:] = STEPS if rows is CREATED else ["claims", "chunks", "vectors", "manifest", "changes", "commit", "publish", "redrive"]
        for _ in range(len(STEPS) + 1):
            try:
                body(queue(spark, rows), 0)
                break
            except Killed:
                pass
        assert not left
        body(queue(spark, rows), 0)  # and once more after its end
    assert everything(w) == want
    assert w.store.sweep() > 0 and everything(w) == want


def test_as_a_stream_with_retries_read_again(spark, tmp_path):
    (tmp_path / "q/new").mkdir(parents=True)
    (tmp_path / "q/new/1.json").write_text("\n".join(json.dumps(dict(zip(("message_id", "arrival_seq", "body", "attempts"), m))) for m in CREATED))
    w = worker(spark, tmp_path)
    for _ in range(5):
        drivers.run(drivers.messages(spark, f"{tmp_path}/q"), w.ingestion(), f"{tmp_path}/cp").awaitTermination()
    got = everything(w)
    # The failing message came back until its fifth delivery; the indexed documents changed once.
    assert [(m, a) for m, a, _ in got["dead"]] == [("m2", 5), ("m5", 5)] and len(got["changes"]) == 2


def test_two_writers_lose_nothing_and_share_no_id(spark, tmp_path):
    store = st.Store(spark, f"{tmp_path}/s", 4)
    change = lambda name, n: spark.createDataFrame([(f"{name}{i:03d}", "upsert") for i in range(n)], "doc_id string, op string")
    errors = []

    def write(name):
        try:
            for k in range(3):
                store.append_changes(change(f"{name}{k}-", 5), attempts=10)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "xy"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = store.changes().collect()
    assert not errors and sorted(r.change_id for r in rows) == list(range(1, 31)) and len({r.doc_id for r in rows}) == 30
    assert sorted(r.change_id for r in store.changes(27).collect()) == [28, 29, 30]


def test_a_writer_that_is_beaten_every_time_gives_up(spark, tmp_path):
    store = st.Store(spark, f"{tmp_path}/s", 4)
    changes = spark.createDataFrame([("a", "upsert")], "doc_id string, op string")
    other = st.Store(spark, f"{tmp_path}/s", 4)
    beaten = []

    def write(now):
        return st.Written(now, {"manifest": {"1": f"f{len(beaten)}"}})

    def slow(now):
        out = st.Written(now, {"manifest": {"1": "mine"}}, *store.write_changes(changes))
        beaten.append(other.commit(write).number)
        return out

    with pytest.raises(RuntimeError, match="3 attempts"):
        store.commit(slow)
    assert beaten == [1, 2, 3] and store.changes().count() == 0
    # A clash without a common bucket needs no second writing.
    tried = []

    def apart(now):
        tried.append(now.number)
        other.commit(lambda s: st.Written(s, {"manifest": {"2": "other"}}))
        return st.Written(now, {"manifest": {"3": "apart"}}, *store.write_changes(changes))

    state = store.commit(apart)
    assert tried == [3] and state.number == 5 and state.tables["manifest"] == {"1": "f2", "2": "other", "3": "apart"} and store.changes().count() == 1


def test_chunks_replaced_and_deleted_twice_are_there_once(spark, tmp_path):
    store = st.Store(spark, f"{tmp_path}/s", 4)
    rows = lambda text: spark.createDataFrame([(f"d{i}", f"c{i}", 1, text) for i in range(9)], st.TABLES["chunks"][1])
    for text in ("old", "new", "new"):
        store.commit(lambda now, t=text: st.Written(now, {"chunks": store.replace("chunks", now, rows(t).select("doc_id"), rows(t))}))
    assert sorted((r.doc_id, r.text) for r in store.read("chunks").collect()) == [(f"d{i}", "new") for i in range(9)]
    gone = spark.createDataFrame([("d1",), ("d2",), ("nobody",)], "doc_id string")
    for _ in range(2):
        store.commit(lambda now: st.Written(now, {"chunks": store.replace("chunks", now, gone)}))
    assert sorted(r.doc_id for r in store.read("chunks").collect()) == [f"d{i}" for i in range(9) if i not in (1, 2)]
    everyone = spark.createDataFrame([(f"d{i}",) for i in range(9)], "doc_id string")
    store.commit(lambda now: st.Written(now, {"chunks": store.replace("chunks", now, everyone)}))
    assert store.read("chunks").count() == 0 and store.state().tables["chunks"] == {}
