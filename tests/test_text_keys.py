import pytest
from pyspark.sql import functions as F

from lexcask.functions import keys, text


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    ("key", "name"),
    [("raws/my-file.v1.pdf", "my-file.v1"), ("/raws/x/a.pdf", "a"), ("a.txt", "a"), ("raws/.env", ""), ("raws/a.", "a"), ("raws/plain", "plain"), ("other/a.b.c", "a.b")],
)
def test_doc_name(spark, key, name):
    assert one(spark, keys.doc_name, key) == name


@pytest.mark.parametrize(("key", "want"), [("raws/a.b.pdf", "chunks/a.b_chunks.jsonl"), ("raws/.env", "chunks/.env_chunks.jsonl"), ("raws/a.", "chunks/a._chunks.jsonl")])
def test_chunk_file_key(spark, key, want):
    assert one(spark, keys.chunk_file_key, key) == want


@pytest.mark.parametrize(("n", "want"), [("1", "a_chunk_0001"), ("10000", "a_chunk_10000")])
def test_ordinals_are_padded_and_never_cut(spark, n, want):
    assert one(spark, lambda k, i: keys.chunk_id(k, i.cast("int")), "raws/a.txt", n) == want


@pytest.mark.parametrize(("key", "route"), [("a.PDF", "pdf"), ("x.docx", "docx"), ("a.md", "text"), ("a.txt", "text"), ("a.html", "unsupported"), ("plain", "unsupported"), (".txt", "unsupported")])
def test_routes(spark, key, route):
    assert one(spark, keys.reader_route, key) == route


@pytest.mark.parametrize(("raw", "want"), [("a+b%28c%29", "a b(c)"), ("x+%zz", "x %zz"), ("%C3%A9", "é")])
def test_decode_key(spark, raw, want):
    assert one(spark, keys.decode_key, raw) == want


def test_path_segment():
    assert keys.path_segment(" /raws/ ") == "raws"
    with pytest.raises(ValueError):
        keys.path_segment(" / ")


def python_snippet(t, q, n=280):
    import re

    terms = [x for x in re.findall(r"[a-z0-9]+", q.lower()) if len(x) > 1]
    if not t:
        return ""
    hits = [i for i in (t.lower().find(x) for x in terms) if i >= 0]
    start = max(0, min(hits) - n // 3) if hits else 0
    out = t[start : start + n].strip()
    return out + "..." if len(out) < len(t) else out


@pytest.mark.parametrize(
    ("t", "q"),
    [("a" * 300, "zzz"), ("please submit", "BMI"), ("please submit", "a"), ("x " * 400 + "needle " + "y " * 400, "the Needle"), ("", "x"), ("  padded  ", "padded"), ("abc", "???"), (None, "x")],
)
def test_snippet(spark, t, q):
    assert one(spark, text.snippet, t, q) == python_snippet(t, q)


def test_white_space_is_pythons(spark):
    odd = " a  b\x1cc　\x85d\t"
    assert one(spark, text.normalize_whitespace, odd) == " ".join(odd.split())
    assert one(spark, text.normalize_whitespace, None) == ""


def test_two_tokenizers(spark):
    assert one(spark, text.ws_tokens, "What  BMI? x") == ["What", "BMI?", "x"]
    assert one(spark, text.overlap_tokens, "What BMI? bmi x") == ["what", "bmi", "x"]


def test_bad_bytes_become_replacement_characters(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\xc3"),)], "b binary")
    assert df.select(text.decode_utf8(F.col("b"))).first()[0] == b"a\xffb\xc3".decode("utf-8", "replace")
