import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lexcask.functions import batches
from lexcask.operators import bm25, segments

from .test_search import CHUNKS, brute


@pytest.fixture(autouse=True)
def few_folders(monkeypatch):
    monkeypatch.setattr(segments, "SLOTS", 2)


def corpus(rng, n, words=60):
    """Texts in which some words stand nearly everywhere and most are rare."""
    vocabulary = [f"w{i}" for i in range(words)]
    return [(f"d{i:03d}", 1 + i % 2, " ".join(rng.choices(vocabulary, [1 / (j + 1) ** 1.3 for j in range(words)], k=rng.randint(0, 40)))) for i in range(n)]


def queries(spark, rng, n=12):
    rows = [(i, " ".join(f"w{min(59, int(rng.expovariate(0.08)))}" for _ in range(rng.randint(0, 8)))) for i in range(n)]
    return rows, spark.createDataFrame([*rows, (90, "zzz"), (91, "")], "query_id long, query string")


def ranked(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.chunk_ord, round(r.score, 4) + 0.0) for r in df.collect())


def wanted(chunks, asked, k):
    return sorted((q, i, d, o, round(-s, 4) + 0.0) for q, text in asked for i, (s, d, o) in enumerate(brute(chunks, text)[:k]))


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_search_equals_brute_force(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)
    rng = random.Random(seed)
    chunks = corpus(rng, 300)
    index = segments.build(spark.createDataFrame(chunks, CHUNKS), f"{tmp_path}/i")
    rows, df = queries(spark, rng)
    for k in (3, 10):
        pruned = bm25.Search(index, df, k, prune_from=0)
        assert pruned.prune
        assert ranked(pruned.top()) == ranked(bm25.Search(index, df, k).top()) == wanted(chunks, [*rows, (90, "zzz"), (91, "")], k)


def test_bounds_spare_postings_of_frequent_words(spark, tmp_path):
    rng = random.Random(3)
    chunks = [(f"d{i:04d}", 1, "the of and " + " ".join(rng.choices([f"x{j}" for j in range(3000)], k=12))) for i in range(3000)]
    # A word that is rare, and one so frequent that it adds next to nothing.
    chunks = [(d, o, t + (" rare" if i % 700 == 0 else "") + (" half" if i % 2 else "")) for i, (d, o, t) in enumerate(chunks)]
    index = segments.build(spark.createDataFrame(chunks, CHUNKS), f"{tmp_path}/i")
    df = spark.createDataFrame([(1, "rare the of and half")], "query_id long, query string")
    search = bm25.Search(index, df, 5, prune_from=0)
    read, every = search.postings_read()
    assert every > 10_000 and read < 0.5 * every
    assert ranked(bm25.Search(index, df, 5, prune_from=0).top()) == wanted(chunks, [(1, "rare the of and half")], 5)


def test_a_word_in_half_of_the_chunks_pairs_no_query_with_all_chunks(spark, tmp_path):
    chunks = [(f"d{i:02d}", 1, "half one" if i % 2 else f"other{i} two") for i in range(40)]
    index = segments.build(spark.createDataFrame(chunks, CHUNKS), f"{tmp_path}/i")
    assert bm25.index_term_stats(index).filter("term = 'half'").first().idf == 0.0
    df = spark.createDataFrame([(1, "half"), (2, "nothing"), (3, "other0 half")], "query_id long, query string")
    search = bm25.Search(index, df, 5)
    assert not search.negative
    top = search.top()
    assert ranked(top) == wanted(chunks, [(1, "half"), (2, "nothing"), (3, "other0 half")], 5)
    # The chunks that fill up are the first 2 * k.
    assert "limit=10" in top._jdf.queryExecution().executedPlan().toString().replace("GlobalLimit 10", "limit=10").replace("TakeOrderedAndProject(limit=10", "limit=10")


def test_negative_scores_find_chunks_without_words_far_down(spark, tmp_path):
    chunks = [(f"d{i:02d}", 1, "same words here" if i < 36 else f"rare{i}") for i in range(40)]
    index = segments.build(spark.createDataFrame([*chunks[:36], *[(d, o, "") for d, o, _ in chunks[36:]]], CHUNKS), f"{tmp_path}/i")
    plain = [*chunks[:36], *[(d, o, "") for d, o, _ in chunks[36:]]]
    df = spark.createDataFrame([(1, "same"), (2, "zzz")], "query_id long, query string")
    search = bm25.Search(index, df, 6, prune_from=0)
    assert search.negative and not search.prune
    assert ranked(search.top()) == wanted(plain, [(1, "same"), (2, "zzz")], 6)


@pytest.mark.parametrize("seed", [4])
def test_scores_after_deltas_equal_a_rebuild(spark, tmp_path, seed):
    rng = random.Random(seed)
    held = {}
    for d, o, t in corpus(rng, 80):
        held.setdefault(d, []).append((d, o, t))
    frame = lambda rows: spark.createDataFrame(rows, CHUNKS)
    index = segments.build(frame([c for v in held.values() for c in v]), f"{tmp_path}/i")
    rows, df = queries(spark, rng)
    for step in range(2):
        before = {f: sorted(os.listdir(f"{f}/docs")) for f in index.state.segments.values()}
        net, fresh = [], []
        for d in rng.sample(sorted(held) + [f"n{step}{i}" for i in range(8)], 25):
            op = rng.choice(["upsert", "upsert", "delete"])
            net.append((d, op))
            held.pop(d, None)
            if op == "upsert" and rng.random() < 0.9:  # an upsert without artifacts is a delete
                held[d] = [(d, o, t) for (_, o, t) in corpus(rng, 2)]
                fresh += held[d]
        artifacts = frame([*fresh, ("unchanged", 1, "w1 w2")])
        index = segments.refresh(index, spark.createDataFrame(net, "doc_id string, op string"), artifacts)
        assert {f: sorted(os.listdir(f"{f}/docs")) for f in before} == before and len(index.state.segments) == step + 2
        written = spark.read.parquet(f"{list(index.state.segments.values())[-1]}/docs")
        assert {r.doc_id for r in written.select("doc_id").collect()} <= {d for d, op in net if op == "upsert"}
        alive = [c for v in held.values() for c in v]
        again = segments.Index(spark, f"{tmp_path}/i")
        rebuilt = segments.build(frame(alive), f"{tmp_path}/r{step}")
        stats = lambda i: sorted((r.term, r.df, round(r.idf, 9)) for r in bm25.index_term_stats(i).collect())
        assert (again.state.n_chunks, again.state.n_words) == (rebuilt.state.n_chunks, rebuilt.state.n_words) and stats(again) == stats(rebuilt)
        want = wanted(alive, [*rows, (90, "zzz"), (91, "")], 7)
        assert ranked(bm25.Search(again, df, 7, prune_from=0).top()) == want == ranked(bm25.top_k(frame(alive), df, 7, again))
    merged = index.merge()
    assert len(merged.state.segments) == 1 and not merged.state.gone
    assert ranked(bm25.top_k(frame(alive), df, 7, merged)) == want


def test_empty_index_and_second_writer(spark, tmp_path):
    empty = segments.build(spark.createDataFrame([], CHUNKS), f"{tmp_path}/i")
    df = spark.createDataFrame([(1, "x")], "query_id long, query string")
    assert bm25.Search(empty, df, 5, prune_from=0).top().count() == 0
    one = spark.createDataFrame([("a", 1, "x y")], CHUNKS)
    filled = empty.add(one)
    with pytest.raises(RuntimeError, match="another writer"):
        empty.add(one)
    assert filled.merge().state.n_chunks == 1
    gone = filled.merge
    assert bm25.top_k(one, df, 5, segments.Index(spark, f"{tmp_path}/i").add(one.limit(0), one.select(F.col("doc_id")))).count() == 0 and gone


def test_index_of_a_batch_is_made_in_parts(monkeypatch):
    """A part holds so many words, whatever the batch holds; blocks are not cut unless one is larger than that by itself."""
    rng = random.Random(5)
    words = [[f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 9))] for _ in range(700)] + [["w1"] * 300]
    n = np.arange(len(words)) + 3
    batch = pa.RecordBatch.from_arrays([pa.array(n), pa.array([len(w) for w in words]), pa.array(words, pa.list_(pa.string()))], names=["n", "dl", "words"])

    def postings(rows):
        return sorted((t, i, f, d) for b in rows for t, ns, tfs, dls in zip(*(b.column(c).to_pylist() for c in ("term", "ns", "tfs", "dls"))) for i, f, d in zip(ns, tfs, dls))

    monkeypatch.setattr(batches, "WORDS", 100)
    monkeypatch.setattr(segments, "BLOCK", 16)
    out = list(segments._blocks(iter([batch])))
    assert postings(out) == sorted((t, i, w.count(t), len(w)) for i, w in zip(n.tolist(), words) for t in set(w))
    assert len(out) > 20 and max(pc.sum(b.column("tfs").flatten()).as_py() for b in out) <= 300
    keys = [(t, k) for b in out for t, k in zip(b.column("term").to_pylist(), b.column("block").to_pylist())]
    assert len(keys) - len(set(keys)) <= 1


def test_a_chunk_is_scored_where_its_postings_are_dealt(spark, tmp_path, monkeypatch):
    """Tasks follow the postings, blocks alone are exchanged, and each task gives a query's best only."""
    rng = random.Random(6)
    chunks = corpus(rng, 200)
    monkeypatch.setattr(segments, "BLOCK", 8)
    monkeypatch.setattr(bm25, "TASK_POSTINGS", 50)
    index = segments.build(spark.createDataFrame(chunks, CHUNKS), f"{tmp_path}/i")
    rows, df = queries(spark, rng)
    search = bm25.Search(index, df, 5)
    postings = search.weights.agg(F.sum("df")).first()[0]
    assert search.n_tasks == -(-postings // 50) > 4
    plan = search.scores()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(run") == 1 and "hashpartitioning(query_id" not in plan
    assert ranked(search.top()) == wanted(chunks, [*rows, (90, "zzz"), (91, "")], 5)
    # Too many terms to be sent: they are joined first.
    monkeypatch.setattr(bm25, "SENT_TERMS", 0)
    assert ranked(bm25.Search(index, df, 5).top()) == wanted(chunks, [*rows, (90, "zzz"), (91, "")], 5)
