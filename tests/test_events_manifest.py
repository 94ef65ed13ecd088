import json

import pytest

from lexcask.operators import events, manifest
from lexcask.streaming.manifest import transition


def body(name="ObjectCreated:Put", bucket="b", key="raws/a+b.txt", **more):
    return json.dumps({"Records": [{"eventName": name, "s3": {"bucket": {"name": bucket}, "object": {"key": key}}, **more}]})


CASES = [
    (body(), None),
    ("{bad", "invalid json body"),
    (None, "invalid json body"),
    ("[]", "unrecognized message"),
    ('{"Records": {}}', "unrecognized message"),
    ('{"Records": [5]}', "event is not an object"),
    ('{"Records": [{"eventName": "x"}]}', "missing s3"),
    ('{"Records": [{"s3": {"bucket": 1}}]}', "missing bucket"),
    ('{"Records": [{"s3": {"bucket": {"name": 5}}}]}', "missing bucket name"),
    ('{"Records": [{"s3": {"bucket": {"name": "b"}}}]}', "missing object"),
    ('{"Records": [{"s3": {"bucket": {"name": "b"}, "object": {}}}]}', "missing object key"),
    ('{"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": "k"}}}]}', "missing event name"),
    (body(name="ObjectRemoved:Delete"), "other event"),
]


@pytest.mark.parametrize(("message", "reason"), CASES)
def test_each_reject_reason(spark, message, reason):
    df = spark.createDataFrame([("m", message)], "message_id string, body string")
    rows = events.validate_object_events(df, events.CREATED).collect()
    assert [r.reject_reason for r in rows] == [reason]
    if reason is None:
        assert rows[0].doc_id == "raws/a b.txt"


def test_removed_events_check_the_bucket(spark):
    df = spark.createDataFrame([("m", body("ObjectRemoved:x", "other"))], "message_id string, body string")
    assert events.validate_object_events(df, events.REMOVED, "b").first().reject_reason == "unrelated bucket"
    assert events.validate_object_events(df, events.REMOVED).first().reject_reason is None


@pytest.mark.parametrize(
    ("version", "want"),
    [("5", 5), ('"5"', 5), ("5.9", 5), ('"5.9"', None), ("0", None), ("-1", None), ('"x"', None), ("null", None)],
)
def test_versions_are_coerced(spark, version, want):
    df = spark.createDataFrame([("m", 0, f'{{"doc_id": " d ", "op": "upsert", "corpus_version": {version}}}')], "message_id string, arrival_seq long, body string")
    r = events.normalize_index_events(df).first()
    assert (r.corpus_version, r.valid, r.doc_id) == (want, want is not None, "d" if want else None)


@pytest.mark.parametrize("message", ["[]", "{bad", None, '{"doc_id": 5, "op": "upsert", "corpus_version": 1}', '{"doc_id": " ", "op": "upsert", "corpus_version": 1}', '{"doc_id": "d", "op": "noop", "corpus_version": 1}'])
def test_malformed_index_events(spark, message):
    df = spark.createDataFrame([("m", 0, message)], "message_id string, arrival_seq long, body string")
    assert events.normalize_index_events(df).first().valid is False
    assert events.batch_failures(events.normalize_index_events(df), events.F.lit(True)).count() == 0


def test_equal_versions_keep_the_later_arrival(spark):
    df = spark.createDataFrame([("d", "upsert", 3, 1), ("d", "delete", 3, 2), ("d", "upsert", 2, 3)], "doc_id string, op string, corpus_version long, arrival_seq long")
    assert [tuple(r) for r in events.coalesce_events(df).collect()] == [("d", "delete", 3, 2)]


LIVES = {
    "new": ["claim_ingest:a", "finalize_ingest:a"],
    "stale request": ["claim_ingest:a", "finalize_ingest:b", "finalize_ingest:a"],
    "reclaim": ["claim_ingest:a", "fail_ingest:a", "claim_ingest:b", "finalize_ingest:b"],
    "claim of indexed": ["claim_ingest:a", "finalize_ingest:a", "claim_ingest:b"],
    "delete": ["claim_ingest:a", "finalize_ingest:a", "claim_delete:c", "finalize_delete:c", "claim_ingest:d"],
    "delete while ingesting": ["claim_ingest:a", "claim_delete:b"],
    "delete failed": ["claim_ingest:a", "finalize_ingest:a", "claim_delete:c", "fail_delete:c", "claim_delete:d", "finalize_delete:c", "finalize_delete:d"],
    "nothing there": ["fail_ingest:a", "claim_delete:a", "finalize_delete:a", "finalize_ingest:a"],
    "fail has no guard": ["claim_ingest:a", "finalize_ingest:a", "fail_ingest:z"],
}


def test_batch_fold_is_the_state_machine(spark):
    rows = [(life, i, *a.split(":")) for life, actions in LIVES.items() for i, a in enumerate(actions)]
    df = spark.createDataFrame(rows, "doc_id string, seq long, action string, req_id string")
    outcomes = {(r.doc_id, r.seq): r.outcome for r in manifest.outcomes(df).collect()}
    states = {r.doc_id: (r.status, r.req_id) for r in manifest.fold(df).collect()}
    for life, actions in LIVES.items():
        status = held = None
        for i, a in enumerate(actions):
            status, held, says = transition(status, held, *a.split(":"))
            assert outcomes[life, i] == says, (life, i)
        assert states.get(life) == ((status, held) if status else None)
    assert outcomes["claim of indexed", 2] == "skipped ingestion" and outcomes["delete", 4] == "skipped ingestion"
    assert outcomes["delete while ingesting", 1] == "skipped deletion" and outcomes["stale request", 1] == "guard failed"
    assert states["delete"][0] == "deleted" and states["fail has no guard"][0] == "ingest failed"
