"""Nearest neighbours by multi-index hashing of learned binary codes.

A bounded sample gives the mean, the principal axes and rotations that bring the axes'
signs close to the values (iterative quantization).  Every vector gets one code of
``BITS`` bits, a sign for each rotated axis; a code falls into substrings of 16 bits, and
each substring is indexed: rows are dealt into shards, and a shard keeps for each
substring its rows sorted by value, with the whole codes and the vectors beside them.

A query asks for every code within a Hamming radius r.  With m substrings and
r = m * a + b, a code within r differs by at most a bits in one of the first b + 1
substrings or by fewer than a in one of the others (pigeonhole), so these values are
probed: by their masks where these are few, else by holding the substring against the
shard's values, which gives the same rows.  Of what is found the whole codes are compared,
and only rows within the radius are ranked, by the cosine of the original vectors in
double precision.

The radius is learned from the sample, so that the share ``REACH`` of its true
neighbours lies within: of a sample of a fifth of all rows, say, the nearest one stands
for the five nearest of the table.  A query that finds fewer than ``k`` rows asks again
with the whole code's length, which is every row; ``exact=True`` does so for all.

Queries are a stated set, held against all rows in shards: a task takes a shard and a group
of queries, both of bounded size, and gives at most ``k`` rows for each query.  Equal
vectors are one class, which holds its ``k + 1`` smallest ids: more of them can never be
among the nearest, as ties go to the smaller id.  So a vector that a third of all rows
hold is one entry of the index.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import core

#: Rows the model is fitted on, at most, and how many of them ask for their neighbours.
SAMPLE, ASKED = 10_000, 600
#: Share of true neighbours in the sample that the radius must reach.
REACH = 0.95
#: Bits of a code, and of a substring (one 16-bit number).
BITS, PART = 256, 16
#: Rows of a shard and queries of a group, at most about; below SMALL rows a shard is not worth a task.
SHARD, GROUP, SMALL = 32_768, 8192, 1024
#: Queries and pairs that are held at a time.
TILE, PAIRS = 64, 65_536
#: Flips whose masks are listed; with more, values are held against each other.
LISTED = 2


@lru_cache(8)
def masks(flips: int) -> np.ndarray:
    """Every 16-bit mask with at most so many bits."""
    return np.array([sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(PART), k)], np.uint16)


class Model:
    """Mean, rotations and radius, fitted on a sample of vectors of ``rows`` in all."""

    def __init__(self, x: np.ndarray, k: int, rows: int, reach: float = REACH, rounds: int = 8, bits: int = BITS):
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        self.dim, self.bits = x.shape[1], bits
        self.mean = unit.mean(0)
        z = unit - self.mean
        _, axes = np.linalg.eigh(z.T @ z)
        z = (z @ axes[:, ::-1])[:4096]
        rng = np.random.default_rng(7)
        turns, n = [], 0
        while n < bits:
            turn = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
                turn = (u @ vt).T
            turns.append(axes[:, ::-1] @ turn)
            n += self.dim
        self.turns = np.concatenate(turns, axis=1)[:, :bits].copy()
        self.radius = self._fit(unit, max(1, round(k * len(x) / max(rows, 1))), reach)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(row, substring): the code as 16-bit numbers."""
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        return np.packbits((unit - self.mean) @ self.turns > 0, axis=1).view(np.uint16)

    def _fit(self, unit: np.ndarray, k: int, reach: float) -> int:
        """The radius within which this share of the sample's own ``k`` nearest lies."""
        own = np.unique(np.linspace(0, len(unit) - 1, min(ASKED, len(unit))).astype(int))
        sim = unit[own] @ unit.T
        sim[np.arange(len(own)), own] = -2
        near = np.argsort(-sim, axis=1)[:, : min(k, len(unit) - 1)]
        if not near.size:
            return self.bits
        apart = distances(np.repeat(self.codes(unit[own]), near.shape[1], 0), self.codes(unit[near.ravel()]))
        return int(np.quantile(apart, reach, method="higher"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of codes, row by row."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class Shard:
    """Codes of a shard's rows with each substring's rows in the order of their values."""

    def __init__(self, codes: np.ndarray, order: np.ndarray):
        self.codes, self.order = codes, order
        self.tables = []
        for s, rows in enumerate(order):
            value = codes[rows, s]
            first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            self.tables.append((value[first], first, np.append(first[1:], len(value))))

    def probed(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """(query, row): rows that the pigeonhole probes of a radius reach."""
        n, m = len(self.codes), self.codes.shape[1]
        whole, rest = divmod(radius, m)
        hit = np.zeros((len(queries), n), bool)
        for s, (values, first, end) in enumerate(self.tables):
            flips = whole if s <= rest else whole - 1
            if flips < 0:
                continue
            if flips <= LISTED and len(masks(flips)) * 8 < len(values):
                for i, v in enumerate(queries[:, s]):
                    asked = v ^ masks(flips)
                    at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
                    for place in at[values[at] == asked]:
                        hit[i, self.order[s][first[place] : end[place]]] = True
            else:
                near = np.bitwise_count(queries[:, s][:, None] ^ values) <= flips
                hit[:, self.order[s]] |= np.repeat(near, end - first, axis=1)
        return hit

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of every code within a radius."""
        i, j = np.nonzero(self.probed(queries, radius))
        near = np.concatenate([distances(queries[i[at : at + PAIRS]], self.codes[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)] or [np.zeros(0, np.int64)]) <= radius
        return i[near], j[near]


def _grid(column: pa.Array, dim: int) -> np.ndarray:
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


INDEX = "shard int, ids array<bigint>, members array<array<bigint>>, vectors binary, codes binary, ranks binary"


def _indexed(model: Model):
    """One row for each shard: its rows, their vectors and codes, and each substring's rows in the order of values."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = _grid(t["embedding"], model.dim)
        codes = model.codes(x)
        order = np.argsort(codes, axis=0, kind="stable").T.astype(np.int32)
        blob = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
        one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), c.combine_chunks())
        return pa.table({"shard": t["shard"].slice(0, 1).cast(pa.int32()), "ids": one(t["id"]), "members": one(t["members"].cast(pa.list_(pa.int64()))), "vectors": blob(x), "codes": blob(codes), "ranks": blob(order)})

    return run


def _best(group: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group: greater scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g, side="left") < k]


def _search(model: Model, k: int):
    """The k best of each query within its radius, of one shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        asks, radius = left["asks"].to_numpy(), left["radius"].to_numpy()
        y = _grid(left["query"], model.dim)
        codes = model.codes(y) if len(y) else np.zeros((0, model.bits // PART), np.uint16)
        size = np.sqrt((y * y).sum(1))
        for r in range(len(right)):
            get = lambda name, kind: np.frombuffer(right[name][r].as_buffer(), kind)  # noqa: B023, E731
            ids, members = right["ids"][r].values.to_numpy(), right["members"][r].values
            x = get("vectors", np.float64).reshape(-1, model.dim)
            norm = np.sqrt((x * x).sum(1))
            shard = Shard(get("codes", np.uint16).reshape(len(ids), -1), get("ranks", np.int32).reshape(-1, len(ids)))
            for reach in np.unique(radius):
                some = np.flatnonzero(radius == reach)
                for at in range(0, len(some), TILE):
                    q = some[at : at + TILE]
                    i, j = shard.within(codes[q], int(reach))
                    i = q[i]
                    score = np.empty(len(i))
                    for lo in range(0, len(i), PAIRS):
                        a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
                        score[lo : lo + PAIRS] = (x[b] * y[a]).sum(1) / (norm[b] * size[a])
                    # One class may hold nothing but the query itself.
                    keep = _best(i, ids[j], score, k + 1)
                    rows = [(a, -s, m) for a, b, s in zip(i[keep].tolist(), j[keep].tolist(), score[keep].tolist()) for m in members[b].as_py() if m != asks[a]]
                    for a, s, m in sorted(rows):
                        out[0].append(int(asks[a]))
                        out[1].append(m)
                        out[2].append(-s)
        q = np.array(out[0], np.int64)
        keep = _best(q, np.array(out[1], np.int64), np.array(out[2]), k) if len(q) else np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(q[keep]), "vec_id": pa.array(np.array(out[1], np.int64)[keep]), "score": pa.array(np.array(out[2], np.float64)[keep])})

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, embedding (double) of the rows that can take part."""
    v = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine)


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """id, members, embedding: a row for each different vector, told by two 64-bit hashes, with its k + 1 smallest ids, of which id is the least."""
    hashed = rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("g"))
    few = hashed.withColumn("place", F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    made = few.groupBy("h", "g").agg(F.sort_array(F.collect_list("vec_id")).alias("members"), F.first("embedding").alias("embedding"))
    return made.select(F.element_at("members", 1).alias("id"), "members", "embedding")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, exact: bool = False) -> DataFrame:
    """The ``k`` nearest found for each row whose id ``every`` divides: query_id, rank, vec_id, score.

    Candidates are all rows of other ids; all of them are returned if they are
    fewer than ``k``.  Ties go to the smaller id.  ``exact`` holds every query against
    every row, in the same shards.

    A null id or vector, a zero vector and one with a null or non-finite component
    take no part.  A vector shorter than the longest one counts as zero beyond its
    end.  Of a repeated query id the least vector asks; repeated candidates are all
    ranked.  An empty table gives none.  Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    schema = "query_id long, vec_id long, score double"
    dim, n = rows.agg(F.max(F.size("embedding")), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    short = F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("embedding")))
    rows = rows.withColumn("embedding", F.when(F.size("embedding") < dim, short).otherwise(F.col("embedding")))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    model = Model(_grid(picked["embedding"], dim), k, n)
    shards = max(-(-n // SHARD), min(2 * core.partitions(spark), -(-n // SMALL)))
    dealt = classes_of(rows, k).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    index = core.checkpoint(dealt.groupBy("shard").applyInArrow(_indexed(model), INDEX))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("asks")).agg(F.min("embedding").alias("query"))
    asked = core.checkpoint(asked)
    groups = -(-asked.count() // GROUP)

    def best(wanted: DataFrame) -> DataFrame:
        """Every group of queries with every shard."""
        q = wanted.select("asks", "query", "radius", F.pmod(F.xxhash64("asks"), F.lit(max(groups, 1))).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))
        r = index.select(F.col("shard").alias("rs"), F.explode(F.sequence(F.lit(0), F.lit(max(groups, 1) - 1))).alias("rg"), "ids", "members", "vectors", "codes", "ranks")
        found = q.groupBy("s", "g").cogroup(r.groupBy("rs", "rg")).applyInArrow(_search(model, k), schema)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    radius = model.bits if exact else model.radius
    out = core.checkpoint(best(asked.withColumn("radius", F.lit(radius))))
    full = out.filter(F.col("rank") == k).select(F.col("query_id").alias("asks"))
    few = asked.join(full, "asks", "left_anti")
    if radius == model.bits or not few.limit(1).count():
        return out
    again = best(few.withColumn("radius", F.lit(model.bits)))
    return out.join(full, out["query_id"] == full["asks"], "left_semi").select(*out.columns).unionByName(again)


def op7(spark, sf_dir):
    """query_id, rank, vec_id, score: the 5 nearest of every 50th row of ``embeddings``."""
    return nearest(core.table(spark, sf_dir, "embeddings"))
