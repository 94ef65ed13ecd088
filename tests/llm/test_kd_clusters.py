import hashlib
import math

import numpy as np
import pytest

from lexcask.llm import kd_clusters as kd

SCHEMA = "vec_id long, embedding array<double>, cluster string, id int, v int"


def rows(seed, n=700, dims=5, spread=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) if not spread else rng.normal(size=(12, dims))[rng.integers(0, 12, n)] * 3 + rng.normal(size=(n, dims)) * spread
    x[::3] = x[0]  # a third of the rows are equal
    out = [(int(i), v.tolist(), "c", 1, 2) for i, v in enumerate(x)]
    return out + [out[4], (None, x[1].tolist(), "", 0, 0), (5000, None, "", 0, 0), (5001, [1.0] * (dims + 1), "", 0, 0), (5002, [None] * dims, "", 0, 0), (5003, [math.inf] * dims, "", 0, 0), (5004, [math.nan] * dims, "", 0, 0), (5005, [], "", 0, 0)]


def plain(data, k, rounds, dims):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v, *_ in data if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)[:k]
    z = [v for _, _, v in first]
    away = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(z))
    for _ in range(rounds):
        of = [away(v)[1] for _, v in kept]
        for j in range(len(z)):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            if mine:
                z[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted(((i is None, i or 0), away(v)[1], away(v)[0]) for i, v in kept), z


@pytest.mark.parametrize("spread", [0.0, 0.01])
def test_equals_plain_rounds(spark, spread):
    data = rows(1, spread=spread)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    want, z = plain(data, 9, 4, 5)
    for tree_rows in (kd.TREE_ROWS, 50):
        got = kd.cluster(df, "vec_id", "embedding", k=9, rounds=4, dims=5, tree_rows=tree_rows)
        assert sorted(((r.id is None, r.id or 0), r.cluster, r.distance) for r in got.rows.collect()) == want
        assert got.centroids.tolist() == z


def test_walk_is_exact_and_assigns_whole_nodes():
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(20, 4))[rng.integers(0, 20, 5000)] * 1000 + rng.normal(size=(5000, 4)) * 5).astype(np.int32)
    _, tree = kd.grow(v, 32)
    z = (rng.normal(size=(15, 4)) * 1000).astype(np.int64)
    z[7] = z[3]  # a tie everywhere: the smaller number wins
    owner, away = kd.owners_of(tree, z)
    true = ((tree.vectors.astype(np.int64)[:, None] - z) ** 2).sum(2)
    assert (owner == true.argmin(1)).all() and (away == true.min(1)).all() and not (owner == 7).any()
    whole = sum(int(tree.span[n, 1] - tree.span[n, 0]) for n, one, _ in kd.walk(tree, z) if one >= 0)
    assert whole > 0.5 * len(v)
    total = kd.sums_of(tree, z)
    for j in range(15):
        assert total[j].tolist() == [*tree.vectors[owner == j].sum(0, dtype=np.int64).tolist(), int((owner == j).sum())]


def test_large_components_and_limit():
    v = np.array([[kd.LIMIT, -kd.LIMIT], [kd.LIMIT - 1, 3]], np.int32)
    z = np.array([[-kd.LIMIT, kd.LIMIT], [0, 1]], np.int64)
    assert (kd.squared(v, z) == ((v.astype(object)[:, None] - z.astype(object)) ** 2).sum(2)).all()
    import pyarrow as pa

    with pytest.raises(ValueError, match="beyond"):
        kd.whole(pa.array([[1e9, 0.0]]), 256, 2)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame(rows(2)[:6], SCHEMA)
    got = kd.cluster(df, "vec_id", "embedding", k=40, dims=5)
    assert len(got.centroids) == 6 and got.rows.count() == 6
    assert kd.cluster(df.limit(0), "vec_id", "embedding", dims=5).rows.count() == 0
