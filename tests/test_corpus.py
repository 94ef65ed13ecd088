import random

import pytest
from pyspark.sql import functions as F

from lexcask.operators import changelog, corpus, snapshot, vectors
from lexcask.sources import lake

CHUNKS = "doc_id string, chunk_id string, text string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_delta_equals_rebuild_and_is_idempotent(spark):
    rng = random.Random(3)
    base = [(f"d{i}", f"d{i}_{k}", "old") for i in range(20) for k in range(2)]
    art = [(f"d{i}", f"d{i}_{k}", "new") for i in range(25) for k in range(3) if i != 7]
    changes = [(n, f"d{rng.randrange(27)}", rng.choice(["upsert", "delete", "noop"])) for n in range(1, 60)]
    b, a = spark.createDataFrame(base, CHUNKS), spark.createDataFrame(art, CHUNKS)
    c = spark.createDataFrame(changes, "change_id long, doc_id string, op string")
    net = {}
    for _, d, op in changes:
        if op != "noop":
            net[d] = op
    want = sorted([r for r in base if r[0] not in net] + [r for r in art if net.get(r[0]) == "upsert"])
    once = corpus.apply_changes(b, c, a)
    assert rows(once) == want
    assert rows(corpus.apply_changes(once, c, a)) == want


def test_upsert_without_artifacts_is_a_delete(spark):
    b = spark.createDataFrame([("d", "d_1", "x")], CHUNKS)
    c = spark.createDataFrame([(1, "d", "upsert")], "change_id long, doc_id string, op string")
    assert corpus.apply_changes(b, c, b.limit(0)).count() == 0


def test_cursor_moves_over_invalid_operations(spark):
    log = spark.createDataFrame([(3, "d", "noop")], "change_id long, doc_id string, op string")
    assert changelog.net_changes(log).count() == 0
    assert changelog.advance_cursor(log, 1).first()[0] == 3
    assert changelog.advance_cursor(log, 3).first()[0] == 3
    assert changelog.latest_change_id(log.limit(0)).first()[0] == 0


def test_append_numbers_on(spark):
    log = spark.createDataFrame([(5, "d", "upsert")], "change_id long, doc_id string, op string")
    new = spark.createDataFrame([(f"n{i:03}", "upsert") for i in range(100)], "doc_id string, op string")
    got = {r.doc_id: r.change_id for r in changelog.append(log, new, "doc_id").collect()}
    assert got == {f"n{i:03}": 6 + i for i in range(100)}


def test_load_lines(spark):
    lines = [(1, '{"doc_id":"d","chunk_id":"c","text":"a"}'), (2, "  "), (3, '{"doc_id":"d","chunk_id":"c","text":"b"}')]
    df = spark.createDataFrame(lines, "line_no long, line string")
    assert rows(corpus.load_lines(df)) == [("c", "d", "b")]


@pytest.mark.parametrize(("n", "size", "batches"), [(200, 200, 1), (201, 40, 6), (1003, 200, 6)])
def test_vector_batches(spark, n, size, batches):
    df = spark.range(n).select(F.lit("d").alias("doc_id"), F.format_string("k%05d", "id").alias("key"))
    r = vectors.batch_summary(df).first()
    assert (r.batch_size, r.n_batches, r.batched) == (size, batches, n > 200)
    assert vectors.batches(df).agg(F.max("batch_no")).first()[0] == batches - 1


def test_vector_guards():
    for bad in ((199, 5), (200, 1)):
        with pytest.raises(ValueError):
            vectors.batch_size(F.lit(1), *bad)


def test_snapshots_round_trip(spark, tmp_path):
    root = f"{tmp_path}/snap"
    assert lake.read_snapshot(spark, root) == (None, 0)
    a = spark.createDataFrame([("d", "d_1", "é\n x")], CHUNKS)
    lake.publish_snapshot(a, root, 3)
    lake.publish_snapshot(a.limit(0), root, 5)
    lake.publish_snapshot(a, root, 4)
    out, version = lake.read_snapshot(spark, root)
    assert version == 5 and out.count() == 0
    got = {r.corpus_version: (r.doc_count, r.chunk_count) for r in lake.snapshot_statistics(spark, root).collect()}
    assert got == {3: (1, 1), 4: (1, 1), 5: (0, 0)}
    with pytest.raises(ValueError):
        lake.publish_snapshot(spark.createDataFrame([("d", "", "x")], CHUNKS), root, 6)
    assert lake.read_snapshot(spark, root)[1] == 5


def test_chunk_files_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("raws/a.txt", "a_chunk_0001", 'é "x"\n'), ("raws/b.txt", "b_chunk_0001", "y")], CHUNKS)
    lake.write_chunks(a, f"{tmp_path}/c")
    assert rows(lake.read_chunks(spark, f"{tmp_path}/c")) == rows(a)


def test_snapshot_rows_that_are_malformed(spark):
    lines = ['{"id":" c ","page_content":"x","metadata":{"doc_id":" d "}}', '{"id":" ","page_content":"x","metadata":{"doc_id":"d"}}', '{"id":"c2","page_content":null,"metadata":{"doc_id":"d"}}', '{"id":"c3","page_content":"x","metadata":5}', "[]", "{bad"]
    df = spark.createDataFrame(list(enumerate(lines)), "row_no long, row string")
    assert rows(snapshot.load(df)) == [("d", "c", "x")]


@pytest.mark.parametrize(("have", "target", "n", "want"), [(5, 5, 1, "skip"), (4, 5, 0, "error"), (4, 5, 2, "rebuild")])
def test_guard(spark, have, target, n, want):
    assert spark.range(1).select(snapshot.rebuild_guard(F.lit(have), F.lit(target), F.lit(n))).first()[0] == want


def test_extraction_by_type(spark):
    import io
    import zipfile

    buf = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>")
    df = spark.createDataFrame([("a.docx", bytearray(buf.getvalue())), ("b.txt", bytearray(b" x \xff y")), ("c.pdf", bytearray(b"p")), ("d.html", bytearray(b"h")), ("e.docx", bytearray(b"no"))], "doc_id string, content binary")
    got = {r.doc_id: r for r in lake.extract_text(df, pdf=lambda b: ["page", None]).collect()}
    assert got["a.docx"].text == "one two" and got["b.txt"].text == "x � y" and got["c.pdf"].text == "page"
    assert got["d.html"].error == "Unsupported file type" and got["e.docx"].text is None and got["e.docx"].error
