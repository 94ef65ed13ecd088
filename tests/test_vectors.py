import collections
import math

import numpy as np
import pytest

from lexcask.operators import vectors

ROW = "key string, embedding array<float>"


def brute(rows, asked, k):
    good = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    dim = max(len(v) for _, v in rows if v)
    unit = lambda v: (lambda p: p / np.linalg.norm(p))(np.pad(np.array(v, np.float32).astype(float), (0, dim - len(v))))
    kept = [(i, unit(v)) for i, v in rows if i is not None and good(v)]
    return {q: [j for _, j in sorted((-round(float(unit(v) @ x), 6), j) for j, x in kept if j != q)[:k]] for q, v in asked if q is not None and good(v)}


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_search_equals_brute_force_and_skips_clusters(spark, spread, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 8))[rng.integers(0, 20, 800)] + spread * rng.normal(size=(800, 8))
    rows = [(f"k{i}", v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(f"same{i}", x[3].astype(np.float32).tolist()) for i in range(300)]
    rows += [(None, [1.0] * 8), ("null", None), ("empty", []), ("zero", [0.0] * 8), ("nan", [float("nan")] * 8), ("part", [None] + [1.0] * 7), ("short", [1.0, 2.0])]
    asked = rows[::40] + rows[-7:]
    out = vectors.top_k(spark.createDataFrame(asked, "query_key string, query array<float>"), spark.createDataFrame(rows, ROW))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = collections.defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got[r.query_key].append(r.key)
    assert dict(got) == brute(rows, asked, 5)


def test_far_clusters_are_not_asked():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    z = rng.normal(size=(30, 8))
    z /= np.linalg.norm(z, axis=1)[:, None]
    size, radius = np.full(30, 20), np.full(30, 0.05)
    batch = lambda: iter([pa.RecordBatch.from_arrays([pa.array(["a"]), vectors._rows(z[:1]), pa.array([0.99])], names=["key", "v", "floor"])])
    asks = [sum(b.num_rows for b in vectors._asking(z, radius, size, 5, first)(batch())) for first in (True, False)]
    assert asks[0] == 1 and asks[1] <= 2


def test_no_rows_and_few_rows(spark):
    asked = spark.createDataFrame([("a", [1.0, 0.0])], "query_key string, query array<float>")
    assert vectors.top_k(asked, spark.createDataFrame([], ROW)).count() == 0
    two = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0])], ROW)
    assert [(r.key, r.score, r["rank"]) for r in sorted(vectors.top_k(asked, two).collect(), key=lambda r: r["rank"])] == [("b", 0.0, 1), ("c", -1.0, 2)]
