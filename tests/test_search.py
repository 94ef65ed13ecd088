import collections
import math

import numpy as np
import pyarrow as pa
import pytest

from lexcask.functions import batches
from lexcask.operators import bm25, chunking, embedding, search

CHUNKS = "doc_id string, chunk_ord int, text string"


def brute(chunks, query):
    n = len(chunks)
    toks = [t.split() for _, _, t in chunks]
    df = collections.Counter(w for t in toks for w in set(t))
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf) if idf else 0
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    avg = sum(map(len, toks)) / n
    out = []
    for (d, o, _), t in zip(chunks, toks):
        tf = collections.Counter(t)
        s = sum(idf[q] * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for q in query.split() if tf[q])
        out.append((-round(s, 6) + 0.0, d, o))
    return sorted(out)


@pytest.mark.parametrize("query", ["What BMI?", "a a b", "zzz", "common", ""])
def test_bm25_ranks_as_brute_force(spark, query):
    texts = ["What is BMI?", "a b c", "a a common", "common x", "common y", "common", "", "b common"]
    chunks = [(f"d{i}", 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(chunks, CHUNKS)
    q = spark.createDataFrame([(1, query)], "query_id long, query string")
    got = sorted((r["rank"], -r.score + 0.0, r.doc_id) for r in bm25.top_k(df, q, 6).collect())
    want = [(i, s, d) for i, (s, d, _) in enumerate(brute(chunks, query)[:6])]
    assert [(r, d) for r, _, d in got] == [(r, d) for r, _, d in want]
    assert all(abs(a - b) < 2e-6 for (_, a, _), (_, b, _) in zip(got, want))


def test_empty_corpus(spark):
    df = spark.createDataFrame([], CHUNKS)
    q = spark.createDataFrame([(1, "x")], "query_id long, query string")
    assert search.search(df, q).count() == 0
    assert search.answers(df, q).first().answer.startswith("I couldn't find")


def test_query_without_words_keeps_candidates(spark):
    df = spark.createDataFrame([(f"d{i}", 1, f"text {i}") for i in range(9)], CHUNKS)
    q = spark.createDataFrame([(1, "???")], "query_id long, query string")
    got = search.search(df, q, 3).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["d0", "d1", "d2"]


def test_rerank_is_within_candidates_and_ignores_case(spark):
    df = spark.createDataFrame([("a", 1, "bmi what"), ("b", 1, "What BMI? zz"), ("c", 1, "nothing")] + [(f"x{i}", 1, f"pad {i}") for i in range(30)], CHUNKS)
    q = spark.createDataFrame([(1, "What BMI?")], "query_id long, query string")
    got = search.search(df, q, 5).orderBy("rank").collect()
    # Words are matched by case for candidates, without it for the re-rank.
    assert got[0].doc_id == "b" and got[0].overlap == 2
    assert {r.doc_id for r in got} <= {r.doc_id for r in bm25.top_k(df, q, 20).collect()}


def test_chat_requests(spark):
    df = spark.createDataFrame([("user", " hi "), ("system", "x"), ("assistant", " "), (None, "x"), ("user", None)], "role string, message string")
    assert [r.reject_reason for r in search.validate_chat(df).collect()] == [None, "unknown role", "message is required", "unknown role", "message is required"]


def test_chunks_put_the_text_together_again(spark):
    t = "One cat. One cat sat! Dogs bark? Dogs bark loud. Rain falls. Rain falls hard. Snow."
    df = spark.createDataFrame([("raws/a.txt", t), ("raws/b.txt", "single sentence"), ("raws/c.txt", "  "), ("raws/d.txt", None)], "doc_id string, text string")
    out = chunking.semantic_chunks(df).orderBy("doc_id", "chunk_ord").collect()
    assert " ".join(r.text for r in out if r.doc_id == "raws/a.txt") == t
    assert [r.text for r in out if r.doc_id == "raws/b.txt"] == ["single sentence"]
    assert {r.doc_id for r in out} == {"raws/a.txt", "raws/b.txt"}
    assert out[0].chunk_id == "a_chunk_0001"


def test_distances_of_a_batch_are_made_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    docs = [[rng.integers(0, 9, rng.integers(0, 6)).tolist() for _ in range(rng.integers(0, 8))] for _ in range(60)]
    words = pa.array(docs, pa.list_(pa.list_(pa.int64())))
    whole = chunking._distances(words).to_pylist()
    held, of_part = [], chunking._of_part
    monkeypatch.setattr(chunking, "_of_part", lambda part: (held.append(len(part.flatten().flatten())), of_part(part))[1])
    monkeypatch.setattr(batches, "WORDS", 50)
    assert chunking._distances(words).to_pylist() == whole
    assert len(held) > 5 and max(held) < 50 + max(sum(map(len, d)) for d in docs)
    assert chunking._distances(words.slice(7, 20)).to_pylist() == whole[7:27]
    assert chunking._distances(words[:0]).to_pylist() == []


def test_word_counts_of_a_batch_are_made_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 8, rng.integers(0, 9)).tolist() for _ in range(40)] + [[]]
    held, repeat = [], np.repeat
    monkeypatch.setattr(np, "repeat", lambda *a: (lambda out: (held.append(len(out)), out)[1])(repeat(*a)))
    monkeypatch.setattr(batches, "WORDS", 20)
    assert embedding._counted(pa.array(texts, pa.list_(pa.int32())), 8).to_pylist() == [[t.count(i) for i in range(8)] for t in texts]
    assert len(held) > 3 and max(held) < 30
    assert embedding._counted(pa.array([], pa.list_(pa.int32())), 8).to_pylist() == []


def test_sentences_are_made_once_and_the_limit_once_for_a_document(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    plan = chunking.semantic_chunks(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1
    assert "> transform(array(sort_array" not in plan
    blank = spark.createDataFrame([("a", " \u2003\n"), ("b", None), ("c", ""), ("d", " . ")], "doc_id string, text string")
    assert [(r.doc_id, r.text) for r in chunking.semantic_chunks(blank).collect()] == [("d", ".")]
