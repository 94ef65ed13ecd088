"""Centroid clustering by kd-tree filtering, exact in whole numbers.

Every task builds kd-trees over the vectors it reads, of at most ``TREE_ROWS`` each; a
node keeps its box, its count and its vectors' sums.  Trees are built once and
written; nothing else is exchanged but sums.  In a round the centroids walk down each
tree: one that is strictly farther than another over a node's whole box is dropped, a
node that is left with one centroid is assigned by its sums alone, and a leaf's vectors
are compared with the centroids that reach it.  What a task sends is a sum for each
centroid and component, whatever the number of vectors.

Vectors count that have exactly ``dims`` components, none null or not finite; others
have no row in the result.  Each component x becomes floor(scale * x).  Every row is a
vector of its own, repeated ones too.  A row without an id is clustered like others
but starts no centroid.  With fewer rows than ``k`` that could start one there are fewer
centroids; with none, and for an empty table, the result is empty.  Ties go to the
smaller centroid.  Components beyond 2**26 after scaling are an error, as sums of
squares would leave 64 bits.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core

K, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
#: Vectors of one tree and of one leaf, at most (a leaf of equal vectors may hold more).
TREE_ROWS, LEAF_ROWS = 8192, 128
#: Components' limit, and the limit up to which products of doubles are exact.
LIMIT, EXACT = 1 << 26, 1 << 22

TREES = "ids array<bigint>, vectors binary, span binary, box binary, sums binary"


def usable(vector: Column, dims: int = DIMS) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def whole(vectors: pa.Array, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x) of every component, a row each."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.floor(scale * flat)
    if len(out) and np.abs(out).max() > LIMIT:
        raise ValueError(f"a component lies beyond {LIMIT} after scaling")
    return out.astype(np.int32).reshape(-1, dims)


@dataclass(frozen=True)
class Tree:
    """Vectors in the order of the leaves; each node's range of them, children (-1: none), box and sums."""

    vectors: np.ndarray
    span: np.ndarray
    box: np.ndarray
    sums: np.ndarray


def grow(vectors: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, Tree]:
    """The order of a tree's vectors and the tree: nodes halved where their box is widest."""
    order = np.arange(len(vectors))
    span, box, sums = [[0, len(vectors), -1, -1]], [], []
    at = 0
    while at < len(span):  # children are numbered after their parents
        lo, hi = span[at][:2]
        part = vectors[order[lo:hi]]
        low, high = part.min(0), part.max(0)
        box.append((low, high))
        sums.append(part.sum(0, dtype=np.int64))
        wide = int(np.argmax(high.astype(np.int64) - low))
        if hi - lo > leaf and high[wide] > low[wide]:
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(part[:, wide], mid)]
            span[at][2:] = [len(span), len(span) + 1]
            span += [[lo, lo + mid, -1, -1], [lo + mid, hi, -1, -1]]
        at += 1
    return order, Tree(vectors[order], np.array(span, np.int32), np.array(box, np.int32), np.array(sums, np.int64))


def reaching(box: np.ndarray, centroids: np.ndarray, squares: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Those of the centroids ``among`` that are not strictly farther than another one over the whole box.

    The one nearest to the middle is held against the others at the corner that suits each of them best.
    """
    z = centroids[among]
    best = int(np.argmin(((2 * z - box.sum(0)) ** 2).sum(1)))
    away = z - z[best]
    gain = squares[among[best]] - squares[among] + 2 * (np.where(away > 0, box[1], box[0]) * away).sum(1)
    return among[gain >= 0]


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: by doubles where their products are, else by integers."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
    else:
        v, c = vectors.astype(np.int64), centroids
    return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)


def walk(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(node, centroid, empty) of nodes assigned whole, (node, -1, its vectors' centroids) of leaves resolved."""
    squares = (centroids**2).sum(1)
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        node, among = todo.pop()
        among = reaching(tree.box[node].astype(np.int64), centroids, squares, among)
        lo, hi, left, right = tree.span[node].tolist()
        if len(among) == 1:
            yield node, int(among[0]), np.zeros(0, np.int64)
        elif left < 0:
            yield node, -1, among[np.argmin(squared(tree.vectors[lo:hi], centroids[among]), axis=1)]
        else:
            todo += [(left, among), (right, among)]


def sums_of(tree: Tree, centroids: np.ndarray) -> np.ndarray:
    """A row for each centroid: its vectors' sums, then their number."""
    dims = centroids.shape[1]
    out = np.zeros((len(centroids), dims + 1), np.int64)
    for node, owner, each in walk(tree, centroids):
        lo, hi = tree.span[node, :2].tolist()
        if owner >= 0:
            out[owner, :dims] += tree.sums[node]
            out[owner, dims] += hi - lo
        else:
            np.add.at(out[:, :dims], each, tree.vectors[lo:hi])
            out[:, dims] += np.bincount(each, minlength=len(out))
    return out


def owners_of(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's centroid and squared distance, in the tree's order."""
    owner = np.zeros(len(tree.vectors), np.int64)
    for node, one, each in walk(tree, centroids):
        lo, hi = tree.span[node, :2].tolist()
        owner[lo:hi] = one if one >= 0 else each
    away = tree.vectors.astype(np.int64) - centroids[owner]
    return owner, (away * away).sum(1)


def _forest(dims: int, scale: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def planted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        order, tree = grow(whole(pa.concat_arrays([b.column("v") for b in held]), scale, dims))
        ids = pa.concat_arrays([b.column("id") for b in held]).take(pa.array(order))
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        blobs = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (tree.vectors, tree.span, tree.box, tree.sums)]
        return pa.RecordBatch.from_arrays([listed, *blobs], names=["ids", "vectors", "span", "box", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                if n and n + part.num_rows > rows:
                    yield planted(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield planted(held)

    return run


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)  # noqa: B023, E731
            tree = Tree(get("vectors", np.int32).reshape(-1, dims), get("span", np.int32).reshape(-1, 4), get("box", np.int32).reshape(-1, 2, dims), get("sums", np.int64).reshape(-1, dims))
            yield batch.column("ids")[i].values, tree


def _round(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for _, tree in _trees(batches, dims):
            total += sums_of(tree, centroids)
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel())], names=["at", "x"])

    return run


def _last(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, dims):
            owner, away = owners_of(tree, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(owner.astype(np.int32)), pa.array(away)], names=["id", "cluster", "distance"])

    return run


@dataclass(frozen=True)
class Clusters:
    """rows (id, cluster, distance), and the final centroids, a row of whole numbers each."""

    rows: DataFrame
    centroids: np.ndarray


def cluster(vectors: DataFrame, id_col: str, vector_col: str, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "2", tree_rows: int = TREE_ROWS) -> Clusters:
    """Lloyd's rounds from the ``k`` vectors whose ``seed:id`` has the least sha256, then a last assignment.

    A new centroid is floor(sum / count) of its vectors in each component; one without vectors stays.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v"), dims))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.filter("id IS NOT NULL").select(key.alias("key"), "id", "v").orderBy("key", "id", "v").limit(k).select("v").toArrow()["v"].combine_chunks()
    centroids = whole(first, scale, dims).astype(np.int64)
    if not len(centroids):
        return Clusters(spark.createDataFrame([], "id long, cluster int, distance long"), centroids)
    trees = core.checkpoint(core.dealt(kept).mapInArrow(_forest(dims, scale, tree_rows), TREES))
    for _ in range(rounds):
        # k * (dims + 1) sums, whatever the number of vectors.
        sums = trees.mapInArrow(_round(centroids), "at int, x long").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        total = np.zeros(len(centroids) * (dims + 1), np.int64)
        total[sums["at"].to_numpy()] = sums["x"].to_numpy()
        total = total.reshape(-1, dims + 1)
        some = total[:, dims] > 0
        centroids = np.where(some[:, None], total[:, :dims] // np.maximum(total[:, dims], 1)[:, None], centroids)
    rows = core.checkpoint(trees.mapInArrow(_last(centroids), "id long, cluster int, distance long"))
    core.release(trees)
    return Clusters(rows, centroids)


def op13(spark, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector of ``embeddings``."""
    found = cluster(core.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found.centroids.tolist())]
    per = found.rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # A row for each centroid, and one.
    named = per.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster").crossJoin(F.broadcast(per.agg(F.sum("cluster_inertia").alias("inertia"))))
    return found.rows.join(F.broadcast(named), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "2") -> str:
    """The same in DuckDB: every vector held against every centroid."""
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key) - 1 AS c, v AS z FROM (SELECT sha256('{seed}:' || vec_id) AS key, v FROM kept ORDER BY key LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, v, c, list_inner_product(v, v) - 2 * list_inner_product(v, z) + list_inner_product(z, z) AS d FROM kept, c{r}) GROUP BY vec_id)"
        )
        if r < rounds:
            parts.append(f"m{r} AS (SELECT c, list(m ORDER BY i) AS z FROM (SELECT c, i, floor(sum(x) / count(*)) AS m FROM (SELECT c, unnest(v) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY c, i) GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c AS c, coalesce(m{r}.z, c{r}.z) AS z FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)")
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(z, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} ON c{rounds}.c = a.c"""
    )
