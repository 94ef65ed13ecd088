"""Queries that carry whole rows, against plain Python over the driver's tables."""

import collections

import pytest

from lexcask.registry import QUERIES
from lexcask.sources.fixtures import frame


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


def chunk(r, lead):
    return f"raws/doc-{r.doc_id}.txt", f"doc-{r.doc_id}_chunk_0001", lead + r.text


def indexed(r):
    return r.doc_id % 7 and r.doc_id % 11


def test_corpus_carries_whole_texts(spark, sf, documents):
    cut = ["doc_id", "chunk_id", "text"]
    assert counted(QUERIES["bootstrap_corpus"](spark, sf).select(cut)) == counted_rows(chunk(r, "old ") for r in documents if indexed(r))
    assert counted(QUERIES["remove_doc"](spark, sf).select(cut)) == counted_rows(chunk(r, "old ") for r in documents if r.doc_id % 7)
    net = net_changes(spark, sf)
    assert counted(QUERIES["merge_chunks"](spark, sf).select(cut)) == counted_rows(chunk(r, "new " if net.get(chunk(r, "")[0]) == "upsert" else "old ") for r in documents)
    published = QUERIES["publish_snapshot"](spark, sf).select("doc_id", "id", "page_content")
    assert counted(published) == counted_rows(chunk(r, "old ") for r in documents)


def counted_rows(rows):
    return collections.Counter(rows)


def net_changes(spark, sf):
    net = {}
    for r in sorted(frame(spark, sf, "doc_changes").collect(), key=lambda r: r.change_id):
        if r.op != "noop":
            net[r.doc_id] = r.op
    return net


def test_delta_carries_whole_texts(spark, sf, documents):
    net = net_changes(spark, sf)
    want = [chunk(r, "old ") for r in documents if indexed(r) and chunk(r, "")[0] not in net]
    want += [chunk(r, "new ") for r in documents if r.doc_id % 10 != 9 and net.get(chunk(r, "")[0]) == "upsert"]
    assert counted(QUERIES["apply_delta"](spark, sf).select("doc_id", "chunk_id", "text")) == counted_rows(want)


def test_snapshot_holds_every_document(spark, sf, documents):
    got = QUERIES["load_snapshot"](spark, sf).select("doc_id", "chunk_id", "page_content")
    assert counted(got) == counted_rows(chunk(r, "" if r.doc_id % 3 else "again ") for r in documents)


def test_changes_reach_documents_of_any_number(spark, tmp_path):
    n = 2000
    spark.range(n).selectExpr("id AS doc_id", "'t' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(10 * n).selectExpr("id AS event_id", "'click' AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    numbers = {int(r.doc_id[9:-4]) for r in frame(spark, str(tmp_path), "doc_changes").collect()}
    assert 0.8 * n < len(numbers) < n and max(numbers) >= n - 10 and min(numbers) == 0
    # Numbers all over the range are changed, and some are left, for the base's rows to stay.
    assert all(len([x for x in numbers if lo <= x < lo + 100]) > 60 for lo in range(0, n, 100))


def test_every_hundredth_vector_is_asked(spark, sf):
    ids = {f"doc-{r.label}_chunk_{r.vec_id}" for r in spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 100 = 0").collect()}
    got = QUERIES["vector_topk"](spark, sf).collect()
    assert any(i.endswith("_chunk_0") for i in ids) and {r.query_key for r in got} == ids and len(got) == 5 * len(ids)
