"""Vector records: batches of a sink, deletes, and an exact cosine search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder

# The writer's parameters.
THRESHOLD, DIVISOR = 200, 5
DIGITS = 6
#: Clusters of a search at most, rows of a block, queries held against it at a time, and what rounding may hide of a bound.
CENTRES, BLOCK_ROWS, TILE, SLACK = 1024, 8192, 256, 2e-6


def batch_size(n: Column, threshold: int = THRESHOLD, divisor: int = DIVISOR) -> Column:
    """Records of a batch: all of them up to the threshold, then a fraction."""
    if threshold < 200 or divisor <= 1:
        raise ValueError("threshold must be at least 200 and divisor above 1")
    return F.when(n > threshold, F.greatest(F.lit(1), F.floor(n / divisor))).otherwise(n).cast("long")


def batches(records: DataFrame, threshold: int = THRESHOLD, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, key, batch_no (from 0) of each document's records, in the order of keys."""
    size = batch_size(F.count("*").over(Window.partitionBy("doc_id")), threshold, divisor)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("key"))
    return records.select("doc_id", "key", size.alias("size"), place.alias("place")).select("doc_id", "key", F.floor((F.col("place") - 1) / F.col("size")).cast("long").alias("batch_no"))


def batch_summary(records: DataFrame, threshold: int = THRESHOLD, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, n_vectors, batched, batch_size, n_batches."""
    n = records.groupBy("doc_id").agg(F.count("*").alias("n_vectors"))
    return n.withColumn("batch_size", batch_size(F.col("n_vectors"), threshold, divisor)).select(
        "doc_id", "n_vectors", (F.col("n_vectors") > threshold).alias("batched"), "batch_size", F.ceil(F.col("n_vectors") / F.col("batch_size")).cast("long").alias("n_batches")
    )


def delete(records: DataFrame, claimed: DataFrame) -> DataFrame:
    """Records without those whose keys the claimed manifest rows (doc_id, vector_keys) list."""
    gone = claimed.select(F.explode("vector_keys").alias("key")).distinct()
    return records.join(gone, "key", "left_anti")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of length 1, zeros beyond a short one's end."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return out / np.linalg.norm(out, axis=1)[:, None] if len(out) else out


def _rows(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of rows of length 1 to the centres."""
    return np.sqrt(np.maximum(2 - 2 * (x @ centres.T), 0))


def _clustered(centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(b.column("v"), centres.shape[1])
            far = _far(x, centres)
            near = far.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("key"), _rows(x), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(x)), near])], names=["key", "v", "c", "away"])

    return run


def _asking(centres: np.ndarray, radius: np.ndarray, rows: np.ndarray, k: int, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Where each query asks: first the nearest clusters until they hold more than k rows, then all others that its floor leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(b.column("v"), centres.shape[1])
            far = _far(x, centres)
            order = np.argsort(far, axis=1)
            held = np.cumsum(rows[order], axis=1) - rows[order]
            begun = np.zeros(far.shape, bool)
            np.put_along_axis(begun, order, held <= k, axis=1)
            if first:
                ask = begun & (rows > 0)
            else:
                # No row of a cluster is nearer than its centre less its radius.
                most = 1 - np.maximum(far - radius, 0) ** 2 / 2
                ask = ~begun & (rows > 0) & (most >= b.column("floor").to_numpy()[:, None] - SLACK)
            i, c = np.nonzero(ask)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(i)), _rows(x[i]), pa.array(c.astype(np.int32))], names=["query_key", "q", "c"])

    return run


def _scored(dim: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best of a block's rows for each query that asks there."""

    def run(asks: pa.Table, rows: pa.Table) -> pa.Table:
        names, keys = np.array(asks["query_key"].to_pylist(), object), np.array(rows["key"].to_pylist(), object)
        out: list[list] = [[], [], []]
        if len(names) and len(keys):
            order = np.argsort(keys)
            keys, x = keys[order], _unit(rows["v"], dim)[order]
            for at in range(0, len(names), TILE):
                name = names[at : at + TILE]
                score = _unit(asks["q"].slice(at, TILE), dim) @ x.T
                score[name[:, None] == keys] = -np.inf
                # Keys are sorted, so equal scores come in their order.
                best = np.argsort(-np.round(score, DIGITS), axis=1, kind="stable")[:, :k]
                for i, row in enumerate(best.tolist()):
                    some = [j for j in row if score[i, j] > -np.inf]
                    out[0] += [name[i]] * len(some)
                    out[1] += keys[some].tolist()
                    out[2] += score[i, some].tolist()
        return pa.table({"query_key": pa.array(out[0], pa.string()), "key": pa.array(out[1], pa.string()), "score": pa.array(out[2], pa.float64())})

    return run


def top_k(queries: DataFrame, records: DataFrame, k: int = 5, centres: int = CENTRES) -> DataFrame:
    """query_key, key, score, rank: an exact search by the cosine metric that the index declares.

    Rows are tied to the nearest of a few of them, and each such cluster knows how far its
    farthest row lies.  A query (query_key, query) asks in its nearest clusters first; the
    k-th best found there rules out, by the triangle inequality, clusters that can hold
    nothing better.  A task multiplies the queries that ask in a block with its rows;
    large clusters are several blocks.

    Null, empty and zero vectors, null keys and vectors with a null or not finite component
    take no part; a short vector counts as zero beyond its end; ties go by key.
    """
    fine = lambda v: F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = lambda rows, key, v: rows.select(F.col(key).cast("string").alias("key"), F.col(v).cast("array<double>").alias("v")).filter(F.col("key").isNotNull() & F.coalesce(fine(F.col("v")), F.lit(False)))
    rows, asked = usable(records, "key", "embedding"), usable(queries, "query_key", "query")
    spark = records.sparkSession
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_key string, key string, score double, rank int")
    dim = max(dim, asked.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0])
    # A bounded sample; which rows it holds changes what is skipped, not what is found.
    picked = rows.orderBy(F.xxhash64("key"), "key").limit(min(centres, math.isqrt(n) + 1)).select("v").toArrow()
    z = _unit(picked["v"], dim)
    folder = shared_folder(spark, "vectors")
    rows.mapInArrow(_clustered(z), "key string, v array<double>, c int, away double").write.parquet(f"{folder}/rows")
    held = spark.read.schema("key string, v array<double>, c int, away double").parquet(f"{folder}/rows")
    radius, size = np.zeros(len(z)), np.zeros(len(z), np.int64)
    for c, far, m in held.groupBy("c").agg(F.max("away"), F.count("*")).collect():
        radius[c], size[c] = far, m
    parts = spark.createDataFrame([(c, int(-(-m // BLOCK_ROWS))) for c, m in enumerate(size.tolist()) if m], "c int, parts int")
    blocks = held.join(F.broadcast(parts), "c").select(F.col("c").alias("rc"), F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("rp"), "key", "v")

    def best(asks: DataFrame) -> DataFrame:
        spread = asks.join(F.broadcast(parts), "c").select("query_key", "q", "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
        return spread.groupBy("c", "p").cogroup(blocks.groupBy("rc", "rp")).applyInArrow(_scored(dim, k), "query_key string, key string, score double").withColumn("score", F.round("score", DIGITS))

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_key").orderBy(F.desc("score"), "key")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_key", "key", "score", "rank")

    ask = "query_key string, q array<double>, c int"
    ranked(best(asked.mapInArrow(_asking(z, radius, size, k, True), ask))).write.parquet(f"{folder}/first")
    first = spark.read.schema("query_key string, key string, score double, rank int").parquet(f"{folder}/first")
    floor = first.filter(F.col("rank") == k).select(F.col("query_key").alias("key"), F.col("score").alias("floor"))
    left = asked.join(floor, "key", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    more = best(left.mapInArrow(_asking(z, radius, size, k, False), ask))
    return ranked(first.drop("rank").unionByName(more))
