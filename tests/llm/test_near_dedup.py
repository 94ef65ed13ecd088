import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from lexcask.llm import components, near_dedup

from .corpus import SCHEMA, counted, docs, words_of


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) where rows of one id and text are one document."""
    sets = []
    for i, t, *_ in rows:
        w = [x.lower() for x in words_of(t)]
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    least = collections.defaultdict(lambda: 1 << 63)
    for i, s in sets:
        if i is not None and s:
            least[frozenset(s)] = min(least[frozenset(s)], i)
    parent = {v: v for v in least.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = list(least.items())
    for k, (a, va) in enumerate(items):
        for b, vb in items[:k]:
            both = len(a & b)
            if 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = sorted((root(va), root(vb)))
                parent[y] = x
    out = []
    for i, s in sets:
        c = None if i is None else i if not s else root(least[frozenset(s)])
        out.append((i, len(s), c, i is None or c == i))
    return out


def test_equals_brute_force(spark):
    rows = docs(6, 90)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id, r["kept"]) for r in near_dedup.near_duplicates(df).collect()]
    assert counted(got) == counted(brute(rows))


def test_a_chain_of_changes_is_one_component(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(12):
        w = list(base)
        for j in range(k):
            w[10 * j] = f"new{j}"
        rows.append((100 - k, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute([(i, t) for i, t in rows])
    assert counted((r.doc_id, r.n_shingles, r.component_id, r["kept"]) for r in got) == counted(want)
    assert len({c for _, _, c, _ in want}) == 1


def test_links_that_no_star_finds(spark):
    """Many texts of a similarity about the threshold to each other, few to a common leader."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(80):
        w = list(base)
        for _ in range(5):
            w[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((k, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert counted((r.doc_id, r.n_shingles, r.component_id, r["kept"]) for r in got) == counted(brute([(i, t) for i, t in rows]))


@pytest.mark.parametrize(("words", "exact"), [(7, False), (60, True)])
def test_no_link_is_lost_where_prefixes_find_them(spark, words, exact):
    """With two bands only, which miss most links: small sets, and all where that is asked for, are found none the less."""
    rng = random.Random(words)
    rows = []
    for k in range(150):
        w = [f"w{k}_{i}" for i in range(words)]
        rows.append((2 * k, " ".join(w)))
        rows.append((2 * k + 1, " ".join(w + [f"y{i}" for i in range(rng.randint(0, max(1, words // 5)))])))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), permutations=5, exact=exact).collect()
    assert counted((r.doc_id, r.n_shingles, r.component_id, r["kept"]) for r in got) == counted(brute([(i, t) for i, t in rows]))


def test_blocks_by_size_lose_no_pair(monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng = np.random.default_rng(1)
    n = rng.integers(1, 60, 40)
    t = pa.table({"band": pa.array([7] * 40, pa.int64()), "v": pa.array(range(40), pa.int64()), "n": pa.array(n, pa.int64()), "label": pa.array(range(40), pa.int64())})
    out = near_dedup._split(t)
    met = set()
    for b in set(out["block"].to_pylist()):
        rows = [(s, v) for x, s, v in zip(out["block"].to_pylist(), out["side"].to_pylist(), out["v"].to_pylist()) if x == b]
        same = b[8:10] == b[10:12]
        met |= {frozenset((v, w)) for s, v in rows for u, w in rows if v != w and (same or s != u)}
    need = {frozenset((i, j)) for i in range(40) for j in range(i) if min(n[i], n[j]) * 100 >= max(n[i], n[j]) * 75}
    assert need <= met and len(met) < 40 * 39 / 2


@pytest.mark.parametrize(("apart", "most"), [(1, 2.3), (300, 2.6), (10_000, 6)])
def test_large_components_of_a_bucket_are_not_paired_with_themselves(apart, most):
    """20,000 sets of one size in one bucket, some of them in a second component: every pair across is met, few rows go out."""
    n = 20_000
    label = np.where(np.arange(n) % (n // apart) == 0, 1, 0)
    t = pa.table({"band": pa.array([7] * n, pa.int64()), "v": pa.array(range(n), pa.int64()), "n": pa.array([50] * n, pa.int64()), "label": pa.array(label, pa.int64())})
    out = near_dedup._split(t)
    assert len(out) <= most * n
    met = 0
    names, side, lab = np.array(out["block"].to_pylist()), out["side"].to_numpy(), out["label"].to_numpy()
    for b in set(names.tolist()):
        own = names == b
        if b[8:10] == b[10:12]:
            met += int((lab[own] == 0).sum()) * int((lab[own] == 1).sum())
        else:
            for s in (0, 1):
                met += int((own & (side == s) & (lab == 0)).sum()) * int((own & (side != s) & (lab == 1)).sum())
    assert met == int((label == 0).sum()) * int((label == 1).sum())


def test_a_star_of_many_rows_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(components, "SALT", 4)
    edges = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 180)] + [(150, 500 + k) for k in range(40)]
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {k: 100 for k in range(100, 180)} | {500 + k: 100 for k in range(40)}


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
    assert got == want


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id, r["kept"]) for r in near_dedup.op9(spark, sf).collect()]
    assert counted(got) == counted(brute(rows))
