import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexcask.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>, v int, rank string, n2 int"


def vectors(seed, n=260, dims=6, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) if not clusters else rng.normal(size=(clusters, dims))[rng.integers(0, clusters, n)] * 3 + rng.normal(size=(n, dims)) * 0.05
    rows = [(i, int(rng.integers(0, 4)), x[i].tolist()) for i in range(n)]
    rows += [(n + i, 1, x[5].tolist()) for i in range(40)]  # equal vectors
    rows += [(900, None, x[0].tolist()), (None, 1, x[0].tolist()), (901, 1, None), (902, 1, [float("nan")] * dims), (903, 1, [None] * dims), (904, 1, [math.inf] * dims), (910, 2, []), (920, 2, [1.0]), (930, 0, [0.0] * dims)]
    rows += [(4, 9, x[4].tolist()), (7, rows[7][1], rows[7][2])]  # one id twice
    random.Random(seed).shuffle(rows)
    return [(*r, 1, "r", 2) for r in rows]


def plain(rows, every, positives=5, negatives=3, low=50, high=95):
    kept = {}
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        q = [math.floor(256 * c) for c in v]
        if i not in kept or (label, v) < kept[i][2]:
            kept[i] = (label, q, (label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (la, va, _) in kept.items():
        if a % every:
            continue
        scored = sorted((-dot(va, v), i, label) for i, (label, v, _) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            fit = [x for x in scored if x[2] != la and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("clusters", [0, 5])
def test_equals_brute_force_over_shards_and_groups(spark, clusters):
    rows = vectors(clusters, clusters=clusters)
    df = hn.usable_rows(spark.createDataFrame(rows, SCHEMA), "vec_id", "label", "embedding")
    for shard, group in ((hn.SHARD, hn.GROUP), (70, 9)):
        got = sorted(tuple(r) for r in hn.mine(df, F.col("id") % 10 == 0, shard=shard, group=group).collect())
        assert got == plain(rows, 10)


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, [float(rng.randint(-(10**6), 10**6)) for _ in range(4)], 1, "", 1) for i in range(80)]
    df = hn.usable_rows(spark.createDataFrame(rows, SCHEMA), "vec_id", "label", "embedding")
    assert sorted(tuple(r) for r in hn.mine(df, F.col("id") % 10 == 0).collect()) == plain(rows, 10)


def test_brackets_hold_and_spare_exact_products_on_clusters(spark):
    import pyarrow as pa

    rows = vectors(4, n=4000, clusters=40)
    df = hn.usable_rows(spark.createDataFrame(rows, SCHEMA), "vec_id", "label", "embedding")
    t = df.toArrow().sort_by("id")
    v = hn._matrix(t["v"], np.int64)
    n2 = t["n2"].to_numpy()
    greatest = int(n2.max())
    aug = hn._augmented(v, n2, greatest)
    pivots = hn.pick_pivots(aug[:500], 32)
    lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
    full = t.append_column("far", lists(hn._distances(aug, pivots))).append_column("asked", lists(hn._distances(np.concatenate([v, np.zeros((len(v), 1))], axis=1), pivots)))
    cell = hn._Cell(full.slice(0, 30), full, greatest, v.shape[1])
    order = np.array([np.flatnonzero(t["id"].to_numpy() == i)[0] for i in cell.id])
    true = v[:30] @ v[order].T
    some = np.arange(30)
    checked = 0
    for _, r in cell.tiles():
        lo, hi = cell.of_rows(some, r)
        assert (lo <= true[:, r]).all() and (true[:, r] <= hi).all()
        tlo, thi = cell.of_tile(some, r)
        assert (tlo[:, None] <= true[:, r]).all() and (true[:, r] <= thi[:, None]).all()
        checked += int((hi >= np.sort(true, axis=1)[:, -5][:, None]).sum())
    assert checked < 0.3 * true.size


def test_empty(spark):
    df = hn.usable_rows(spark.createDataFrame([], SCHEMA), "vec_id", "label", "embedding")
    assert hn.mine(df, F.col("id") % 10 == 0).collect() == []
    one = hn.usable_rows(spark.createDataFrame([(10, 1, [1.0], 1, "", 1)], SCHEMA), "vec_id", "label", "embedding")
    assert hn.mine(one, F.col("id") % 10 == 0).collect() == []
