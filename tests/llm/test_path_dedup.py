import hashlib

import pytest

from lexcask.llm import path_dedup as p

from .corpus import SCHEMA, counted, docs, words_of

LAST = 1 << 63


def brute(rows, length):
    data = [(LAST if i is None else i, words_of(t)) for i, t, *_ in rows]
    first = {}
    for i, w in data:
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in data:
        own, cover = set(), [False] * len(w)
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            if first[g] < i or g in own:
                cover[k : k + length] = [True] * length
            own.add(g)
        out.append((None if i == LAST else i, len(w), sum(cover), b" ".join(x for x, c in zip(w, cover) if not c)))
    return out


@pytest.mark.parametrize(("length", "gram"), [(20, 10), (5, 3)])
def test_equals_brute_force(spark, length, gram):
    rows = docs(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in p.path_dedup(df, length=length, gram=gram).collect()]
    assert counted(got) == counted(brute(rows, length))


def test_paths_name_their_sources(spark):
    rows = [r for r in docs(3) if r[0] is not None and r[0] not in (3, 7)]
    by_id = {i: words_of(t) for i, t, *_ in rows}
    found = 0
    for r in p.path_dedup(spark.createDataFrame(rows, SCHEMA)).collect():
        for x in r.paths:
            found += 1
            source = by_id[x.source_id]
            assert x.source_id < r.doc_id or (x.source_id == r.doc_id and x.source_start < x.start)
            assert by_id[r.doc_id][x.start : x.start + x.n_words] == source[x.source_start : x.source_start + x.n_words]
    assert found > 5


def test_empty_table(spark):
    assert p.path_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    got = {r.doc_id: r for r in p.op2(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for i, n, gone, kept in brute(rows, 20):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, gone, hashlib.sha256(kept).hexdigest())
