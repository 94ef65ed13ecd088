import corpus_pipeline
from lexcask.llm import quality, secret_scan

from .test_near_dedup import brute as near
from .test_suffix_dedup import brute as repeated
from .test_tokens import check_packing


def test_stages_equal_plain_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = {r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect()
        assert name == "packing" or docs.columns == columns
    first = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(first).filter("kept").collect()}
    assert set(at["quality_rules"]) == kept
    rows = [(i, r.text) for i, r in at["quality_rules"].items()]
    assert set(at["near_dedup"]) == {i for i, _, _, keep in near(rows) if keep}
    rows = [(i, r.text) for i, r in at["near_dedup"].items()]
    for i, _, spans, kept_bytes in repeated(rows, 50):
        text = at["suffix_dedup"][i].text
        # Characters cut in part stay whole.
        assert 0 <= len(text.encode()) - len(kept_bytes) <= 6 * len(spans) and at["suffix_dedup"][i].n_chars == len(text)
        assert spans or text.encode() == kept_bytes
    masked = {r.doc_id: r.masked for r in secret_scan.scan(spark.createDataFrame(list(at["suffix_dedup"].values()), first.schema)).collect()}
    assert {i: r.text for i, r in at["secret_scan"].items()} == masked
    assert check_packing(at["packing"], masked) > 0.95


def test_run_and_odd_rows(spark, tmp_path):
    import os

    text = " ".join(f"w{i}a w{i}b the w{i}c" for i in range(40))
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text + " x", None, None, None), (3, None, "en", "s", 0), (1, text, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    # Copies of one id, of another and of none are one document.
    out = out.collect()
    assert {r.doc_id for r in out} == {1} and len({(r.doc_id, r.start) for r in out}) == len(out)
    os.makedirs(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_copies_without_an_id(spark):
    texts = [" ".join(f"v{k}w{i}" for i in range(60)) for k in range(3)]
    rows = [(1, texts[0]), (1, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[1] + " x"), (None, texts[2]), (4, texts[2]), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()]
    assert sorted((i for i, _ in got), key=str) == [1, 4, None, None] and {t for _, t in got if t} >= {texts[0], texts[2]} and len(got) == 4


def test_rows_are_judged_by_themselves(spark):
    a, b, c = (" ".join(f"{x}{i} the" for i in range(60)) for x in "abc")
    near = lambda t: t + " more"
    cases = [
        # An exact copy goes whatever other text its id has.
        ([(0, b), (1, a), (1, b), (2, b), (3, c)], {b: 1, a: 1, c: 1}),
        # Two near texts of one id are one group, an unrelated third is not.
        ([(1, a), (1, near(a)), (1, c), (2, near(c))], {"a": 1, "c": 1}),
        # A text is not dropped for what its id's other text resembles.
        ([(0, near(a)), (1, a), (1, c)], {"a": 1, "c": 1}),
    ]
    for rows, want in cases:
        got = [r.text for r in corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
        counted = {k: sum(t == k if len(k) > 1 else t.startswith(k) for t in got) for k in want}
        assert counted == want and len(got) == sum(want.values()), (rows, got)
    # Equal ids and texts with other columns: the first as JSON, whatever the order of rows.
    rows = [(5, a, s) for s in "zyxw"]
    for order in (rows, rows[::-1]):
        got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(order, "doc_id long, text string, source string"), "").collect()
        assert [(r.doc_id, r.source) for r in got] == [(5, "w")]


def test_clashing_names(spark):
    rows = [(1, " ".join(f"w{i}a the w{i}b" for i in range(60)), "k", "n", "s", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words string, spans string, candidates string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "kept", "n_words", "spans", "candidates"], name
        assert [tuple(r)[2:] for r in docs.collect()] == [("k", "n", "s", "c")]
