import hashlib

import pytest

from lexcask.llm import suffix_dedup as s

from .corpus import SCHEMA, counted, docs

LAST = 1 << 63


def brute(rows, length):
    """(doc_id, n_bytes, spans, kept) of each row: bytes covered by a string that starts in a smaller id."""
    data = [(LAST if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                cover[p : p + length] = b"\1" * length
        spans, p = [], 0
        while p < len(b):
            if cover[p]:
                q = p
                while q < len(b) and cover[q]:
                    q += 1
                spans.append((p, q))
                p = q
            else:
                p += 1
        out.append((None if i == LAST else i, len(b), tuple(spans), bytes(x for x, c in zip(b, cover) if not c)))
    return out


@pytest.mark.parametrize(("length", "gram"), [(50, 16), (20, 9)])
def test_equals_brute_force(spark, length, gram):
    rows = docs()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r.doc_id, r.n_bytes, tuple((x.start, x.end) for x in r.spans), bytes(r.kept)) for r in s.suffix_dedup(df, length=length, gram=gram).collect()]
    assert counted(got) == counted(brute(rows, length))


def test_hot_anchors_give_the_same(monkeypatch):
    """The merge itself, chunk by chunk, with every repeated anchor dealt out by whole windows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from lexcask.llm import core

    rows = [(i, t) for i, t, *_ in docs(4) if i is not None]
    t = pa.table({"chunk": pa.array([hash(i) % 4 for i, _ in rows], pa.int32()), "id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([x or "" for _, x in rows])})
    chunks = [t.filter(pc.equal(t["chunk"], c)) for c in range(4)]

    def whole(parts):
        anchors = pa.concat_tables([s._anchors(50, 16, parts)(c) for c in chunks])
        replies = pa.concat_tables([core.repeated(x) for b in range(parts) if len(x := anchors.filter(pc.equal(anchors["bucket"], b)))])
        runs = pa.concat_tables([s._runs(50, 16, parts)(c, replies.filter(pc.equal(replies["chunk"], k))) for k, c in enumerate(chunks)])
        merged = pa.concat_tables([s._merge(50)(x) for p in range(parts) if len(x := runs.filter(pc.equal(runs["part"], p)))])
        out = []
        for k, c in enumerate(chunks):
            done = s._apply(50, (), False)(c, merged.filter(pc.equal(merged["chunk"], k)))
            out += [(r["id"], r["n_bytes"], tuple((x["start"], x["end"]) for x in r["spans"]), r["kept"]) for r in done.to_pylist()]
        return counted(out)

    want = counted(brute([(i, x) for i, x in rows], 50))
    assert whole(3) == want
    monkeypatch.setattr(core, "HOT", 1)
    assert whole(3) == want


def test_loser_tree_merges_and_knows_prefixes():
    import random

    rng = random.Random(5)
    runs = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))}) for _ in range(7)]
    packed = [s.Run(s.pack_run(r, [1] * len(r), [[0]] * len(r), 16)) for r in runs if r]
    out = list(s.merge_runs(packed))
    assert [k for k, *_ in out] == sorted(k for r in runs for k in r)
    for (a, *_), (b, lcp, *_) in zip(out, out[1:]):
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp == common


def test_whole_characters_and_carried_columns(spark):
    text = "é" * 60
    df = spark.createDataFrame([(1, "a" + text, "k1"), (2, "bb" + text + "tail", "k2")], "doc_id long, text string, n_bytes string")
    rows = {r.doc_id: r for r in s.suffix_dedup(df, characters=True).collect()}
    assert rows[2].kept.decode() == "bbtail"
    out = s.suffix_dedup(df.withColumnRenamed("n_bytes", "mine"), carry=("mine",)).collect()
    assert {r.doc_id: r.mine for r in out} == {1: "k1", 2: "k2"}


def test_empty_table_and_bad_parameters(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert s.suffix_dedup(df).count() == 0
    with pytest.raises(ValueError):
        s.suffix_dedup(df, length=10)


def test_query(spark, sf):
    got = {r.doc_id: r for r in s.op8(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for i, n, spans, kept in brute(rows, 50):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


def test_rows_without_an_id_are_dealt_out(spark):
    """A third of all rows without an id, and a third of one id, fall into as many chunks as any others."""
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text number {i} of many " * 3) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    chunks, n, _ = s.core.chunks_of(df, "doc_id", "text")
    sizes = [r["count"] for r in chunks.groupBy("chunk").count().collect()]
    assert max(sizes) < 4 * 600 / n
    got = s.suffix_dedup(df).collect()
    assert counted((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in got) == counted(brute(rows, 50))


def test_work_follows_the_hashes_not_the_buckets():
    import numpy as np

    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2))
    cut = s.core.filled(h, 1 << 30)
    assert len(cut) <= 50 and [x for _, lo, hi in cut for x in h[lo:hi]] == h.tolist()
    assert all((s.core.bucket_of(h[lo:hi], 1 << 30) == b).all() for b, lo, hi in cut)
