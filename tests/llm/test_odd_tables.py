"""Empty tables, very long texts and clashing names, for operators whose own tests hold none."""

import hashlib
import random

import pytest

import corpus_pipeline
from lexcask.llm import chat_format, packing, path_dedup, pieces, quality, suffix_dedup, tokens

CLASH = "doc_id long, text string, id string, ids string, ends string, decoded string, kept string, chunk int, n_words string, spans string, paths string, start string, bucket string"
EXTRA = ("i", "s", "e", "d", "k", 1, "n", "p", "q", "r", "b")
OPERATORS = {"path": path_dedup.path_dedup, "suffix": suffix_dedup.suffix_dedup, "pack": packing.pack, "pieces": pieces.encode, "quality": quality.judge}


def long_text(n=60_000, seed=1):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    long = long_text()
    return {1: long, 2: "some words " + long[1000:2000], 3: None, 4: ""}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], CLASH)).collect() == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_long_texts_and_clashing_names(spark, texts, name):
    df = spark.createDataFrame([(i, t, *EXTRA) for i, t in texts.items()] + [(2, texts[2], *EXTRA)], CLASH)
    rows = OPERATORS[name](df).collect()
    if name == "pack":
        for i, t in texts.items():
            want = [*tokens.load(tokens.byte_bpe_path()).encode(t or "", add_special_tokens=False).ids, 0] if hasattr(tokens, "load") else None
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
            assert sum(r.length for r in own) == own[0].doc_tokens * (2 if i == 2 else 1)
            if want:
                assert own[0].doc_tokens == len(want)
        return
    assert len(rows) == 5
    by = {r.doc_id: r for r in rows}
    if name == "path":
        assert by[1].n_words == 60_000 and by[1].n_removed == 0 and by[2].n_removed > 50 and bytes(by[1].kept) == texts[1].encode()
    elif name == "suffix":
        assert by[1].n_bytes == len(texts[1].encode()) and bytes(by[1].kept) == texts[1].encode() and len(by[2].kept) <= 60
    elif name == "pieces":
        assert by[1].ends[-1] == len(texts[1].encode()) and hashlib.sha256(by[1].decoded.encode()).digest() == hashlib.sha256(texts[1].encode()).digest() and by[3].ids == []
    else:
        assert by[1].n_words == 60_000 and by[3].base_failed and not by[4]["kept"] and by[1]["chunk"] == 1


def test_stages_without_rows_and_with_a_long_text(spark, texts):
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, spark.createDataFrame([], CLASH), "")
        assert empty.count() == 0, name
        out = stage(spark, spark.createDataFrame([(1, texts[1], *EXTRA)], CLASH), "")
        if name == "packing":
            assert sum(r.length for r in out.collect()) > 60_000
        elif name != "quality_rules":
            assert [(r.doc_id, r.text) for r in out.collect()] == [(1, texts[1])] and out.columns == spark.createDataFrame([], CLASH).columns, name


def test_a_long_turn_is_one_block(spark, texts):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", texts[1]), (1, 2, "user", "so"), (1, 3, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    rows = {r.example: r for r in chat_format.whole_examples(chat_format.expand(df)).collect()}
    assert sorted(rows) == [1, 3] and rows[1].text[rows[1].loss_start : rows[1].loss_end] == texts[1] and rows[3].text.startswith(rows[1].text)
