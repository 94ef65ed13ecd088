import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lexcask.llm import packing, pieces, token_counts, tokens

from .corpus import SCHEMA, docs

ODD = [
    None, "", " ", "  ", "a  b", " a", "a ", "\n a\n\n  b", "it's <|endoftext|> fine<|endoftext|>", "a\xa0 b 　c", "▁x ▁▁ y", "x▁ y", " ́x",
    "tab\t x \t y", "日本語 テキスト", "🙂 🙂🙂 x", "a\x1c b\x1c c", "é\x00 b", "x" * 2000 + " " + "y" * 300, "a\r\n b", "​ z ‍ w", "<s> </s> <unk> <0x41>", "'s 's'd  'll",
]


def texts():
    rng = random.Random(3)
    return ODD + [t for _, t, *_ in docs(8)] + ["".join(rng.choice("ab \n\t'é▁!3") for _ in range(60)) for _ in range(300)]


def test_byte_bpe_equals_the_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.byte_bpe_path())
    for memory in (tokens.MEMORY, 50):
        coder = tokens.ByteBpe(tokens.byte_bpe_path())
        coder_memory, tokens.MEMORY = tokens.MEMORY, memory
        try:
            got = coder.encode(texts())
        finally:
            tokens.MEMORY = coder_memory
        for t, g in zip(texts(), got):
            assert g == struct.pack(f"<{len(g) // 4}I", *lib.encode(t or "", add_special_tokens=False).ids), repr(t)


def test_pieces_equal_the_library_and_keep_their_places():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.piece_path())
    for t, (ids, ends, decoded) in zip(texts(), pieces.Encoder(pieces.piece_path()).encode(texts())):
        t = t or ""
        want = lib.encode(t)
        assert list(struct.unpack(f"<{len(ids) // 4}i", ids)) == want, repr(t)
        assert decoded == lib.decode(want)
        assert ends.tolist() == [p.end for p in lib.encode(t, return_type="proto").pieces], repr(t)


def double_array(entries):
    """A compiled map of byte strings, built the plain way: every node gets a block of 256 units of its own."""
    trie = {}
    for key in entries:
        node = trie
        for b in key:
            node = node.setdefault(b, {})
        node[None] = key
    blob, where = b"", {}
    for key, value in entries.items():
        where[key] = len(blob)
        blob += value + b"\0"
    units = [0] * 256
    work = [(trie, 0)]
    while work:
        node, at = work.pop()
        base = len(units)
        units += [0] * 256
        offset = base ^ at
        assert offset < 1 << 21 or offset & 255 == 0
        label = units[at] & 0x800000FF
        units[at] = label | (offset << 10 if offset < 1 << 21 else (offset >> 8) << 10 | 1 << 9) | (1 << 8 if None in node else 0)
        for b, child in node.items():
            place = base ^ (b or 0) if b is not None else base
            if b is None:
                units[place] = 1 << 31 | where[child]
            else:
                units[base ^ b] = b
                work.append((child, base ^ b))
    trie_bytes = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(trie_bytes)) + trie_bytes + blob


def test_compiled_map_takes_the_longest_prefix():
    entries = {"ﬁ".encode(): b"fi", b"ab": b"X", b"abc": b"YY", "é".encode(): "é".encode(), b"\t": b" ", "①".encode(): b"1"}
    m = pieces.CharsMap(double_array(entries))
    assert m.longest(b"abcd", 0) == (3, b"YY") and m.longest(b"abd", 0) == (2, b"X") and m.longest(b"zab", 0) is None
    assert m.longest("ﬁx".encode(), 0) == (3, b"fi")


@pytest.mark.parametrize("squeeze", [False, True])
def test_normalizing_models_keep_places(squeeze, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(pieces.piece_path(), "rb").read())
    entries = {"ﬁ".encode(): b"fi", b"\t": b" ", "①".encode(): b"1", "Ａ".encode(): b"A", "ab".encode(): b"ba"}
    model.normalizer_spec.precompiled_charsmap = double_array(entries)
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    lib = sentencepiece.SentencePieceProcessor(model_file=str(path))
    some = ["ﬁnd the ﬁre", "① ab\tAb Ａ  x", "plain text", "  lead and  trail  ", "", "日本語ﬁ ab"]
    for t, (ids, ends, decoded) in zip(some, pieces.Encoder(str(path)).encode(some)):
        want = lib.encode(t)
        assert list(struct.unpack(f"<{len(ids) // 4}i", ids)) == want, t
        assert decoded == lib.decode(want)
        assert [e for e, p in zip(ends.tolist(), lib.encode(t, return_type="proto").pieces) if e != p.end] == [], t


def test_cut_covers_a_document_in_few_pieces():
    for n in [*range(1, 3000, 7), 1008, 1009, 1023, 1024, 2048]:
        parts = packing.cut(n)
        assert [s for s, _, _ in parts] == [0, *[s + k for s, k, _ in parts][:-1]] and sum(k for _, k, _ in parts) == n
        assert all(k <= size for _, k, size in parts) and len(parts) <= n // 1024 + 7


def check_packing(rows, texts_by_id, eos=0, capacity=1024):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.byte_bpe_path())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    used = 0
    for pieces_ in sequences.values():
        at = 0
        for r in sorted(pieces_, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        used += capacity if at & (at - 1) else at
    total = 0
    for i, text in texts_by_id.items():
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, eos]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == [0, *[r.start + r.length for r in own][:-1]] and own[-1].start + own[-1].length == len(ids)
        for r in own:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length]))
        total += len(ids)
    return total / used


def test_packing(spark, sf):
    share = check_packing(packing.op3(spark, sf).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})
    assert share > 0.97


def test_packing_of_odd_rows(spark):
    rows = [(i, t) for i, (_, t, *_) in enumerate(docs(5))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sequence_id", packing.core.F.lit("clash")).repartition(2)
    out = packing.pack(df)
    got = out.collect()
    check_packing(got, dict(rows))
    assert all(len(r.ids) == 4 * r.length for r in got)
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, capacity=1000)


def test_histogram_answers_every_limit(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.byte_bpe_path())
    rows = docs(7)
    sizes = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows] + [5000, 9000]
    df = token_counts.lengths(spark.createDataFrame(rows, SCHEMA)).unionByName(spark.createDataFrame([(5000,), (9000,)], "n_tokens long"))
    h = token_counts.histogram(df).cache()
    got = {r.n_tokens: r for r in h.collect()}
    assert set(got) == set(sizes)
    for n, r in got.items():
        assert r.n_docs == sizes.count(n)
        assert (r.docs_le, r.tokens_le) == (sum(s <= n for s in sizes), sum(s for s in sizes if s <= n))
        assert (r.docs_gt, r.tokens_gt) == (sum(s > n for s in sizes), sum(s for s in sizes if s > n))
        assert r.truncated_total == sum(min(s, n) for s in sizes)
    at = {r.limit: r for r in token_counts.totals_at(h, [0, 17, 512, 10**6]).collect()}
    assert {k: (r.truncated_total, r.docs_over) for k, r in at.items()} == {k: (sum(min(s, k) for s in sizes), sum(s > k for s in sizes)) for k in (0, 17, 512, 10**6)}
    ordered = sorted(sizes)
    for r in token_counts.quantiles(h, [0.5, 1.0]).collect():
        assert r.n_tokens == ordered[-(-len(ordered) * int(r.share * 100) // 100) - 1]
    assert token_counts.histogram(token_counts.lengths(spark.createDataFrame([], SCHEMA))).count() == 0


def test_pieces_query(spark, sf):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.piece_path())
    docs_ = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pieces.op10(spark, sf).collect():
        ids = lib.encode(docs_[r.doc_id])
        assert (r.n_tokens, r.n_bytes) == (len(ids), len(docs_[r.doc_id].encode()))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_histogram_of_odd_tables(spark):
    rows = [(None, "one two"), (1, "one two"), (1, "one two"), (2, None), (3, "")]
    h = token_counts.histogram(token_counts.lengths(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_docs", F.lit("clash"))))
    got = {r.n_tokens: r.n_docs for r in h.collect()}
    assert got == {0: 2, 2: 3}
    assert token_counts.totals_at(h, []).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.histogram(token_counts.lengths(empty)).count() == 0


def test_token_count_query(spark, sf):
    """Against the library, document by document, and sums by plain loops."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.byte_bpe_path())
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n = sorted(len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False))
    got = {r.n_tokens: r for r in token_counts.op5(spark, sf).collect()}
    assert set(got) == set(n)
    for k, r in got.items():
        assert (r.n_docs, r.docs_le, r.tokens_gt, r.truncated_total) == (n.count(k), sum(x <= k for x in n), sum(x for x in n if x > k), sum(min(x, k) for x in n))
