"""Hard-negative mining with a pivot table.

Inner products are turned into distances: every row gets one more component,
sqrt(M**2 - |x|**2) for the greatest norm M, and an anchor gets 0 there, so that
|a - x|**2 = |a|**2 + M**2 - 2 * <a, x>.  The distances of every row to a few pivots are
stored beside it.  For an anchor, the greatest difference of its and a row's distances
to a pivot is a lower bound of their distance and the least sum an upper one; so they
bracket the score, for single rows and for tiles of neighbouring rows.  What the
brackets leave is checked by exact inner products of whole numbers, so the result does
not depend on the pivots.

Anchors are a stated query set, held against all rows in blocks: rows are dealt by id
into shards and anchors into groups, both of bounded size, and a task takes one shard
and one group, once to find the positives and once, with their scores, for the
negatives.  It gives at most ``positives`` rows for an anchor, and ``negatives`` for
each positive; neither a shard nor a group needs to fit a broadcast.

Rows without an id or a label, without a vector, or with a null or not finite component
take no part.  Of several rows with one id the one of the least label and vector
counts.  A vector shorter than others counts as zero beyond its end.  Ties go to the
smaller id.  An anchor with no other row of its label has no rows in the result, nor has
a positive with no row in its range; an empty table gives none.  Scores beyond 64 bits
are an error.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import core

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 50, 95
#: Pivots, and the rows (of least hash of their ids) that they are picked from.
PIVOTS, SAMPLE = 16, 2048
#: Rows of a shard and anchors of a group, at most about; below SMALL rows a shard is not worth a task.
SHARD, GROUP, SMALL = 131_072, 16_384, 1024
#: A tile: rows and anchors whose scores are held at a time.
TILE, ANCHORS = 1024, 512
#: Up to here sums of products of doubles are exact.
EXACT = 1 << 52

ROWS = "id bigint, label bigint, v array<bigint>, n2 bigint"


def _matrix(lists: pa.Array, kind, width: int | None = None) -> np.ndarray:
    """Lists as rows of a matrix, zeros beyond their ends."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=0)) if width is None else width
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.astype(kind).reshape(-1, width)
    out = np.zeros((len(size), width), kind)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _whole(scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(scale * _matrix(b.column("v"), np.float64))
            # Squares of over 62 bits are told from sums that would wrap.
            if len(x) and (x * x).sum(1).max(initial=0) >= 2.0**62:
                raise ValueError("scores leave 64 bits")
            x = x.astype(np.int64)
            size = b.column("v").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = x[np.arange(x.shape[1]) < size[:, None]]
            v = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), v, pa.array((x * x).sum(1))], names=["id", "label", "v", "n2"])

    return run


def usable_rows(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """id, label, v (whole numbers), n2 (its square) of each id that takes part; ``label`` gives another label from id and label."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)))
    if label is not None:
        rows = rows.withColumn("label", label.cast("long"))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    return one.mapInArrow(_whole(scale), ROWS)


def _augmented(v: np.ndarray, n2: np.ndarray, greatest: int) -> np.ndarray:
    return np.concatenate([v.astype(np.float64), np.sqrt(np.maximum(greatest - n2.astype(np.float64), 0))[:, None]], axis=1)


def pick_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Rows far from each other: each is the one farthest from those before."""
    at, away = [], np.full(len(sample), np.inf)
    while len(at) < min(n, len(sample)):
        at.append(int(np.argmax(away)) if at else 0)
        away = np.minimum(away, ((sample - sample[at[-1]]) ** 2).sum(1))
    return sample[at]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each row to each pivot."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], axis=1) if len(x) else np.zeros((0, len(pivots)))


def _table(pivots: np.ndarray, greatest: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def lists(m: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, n2 = _matrix(b.column("v"), np.int64, width), b.column("n2").to_numpy()
            as_row, as_anchor = _augmented(v, n2, greatest), np.concatenate([v, np.zeros((len(v), 1))], axis=1)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "label", "v", "n2")], lists(_distances(as_row, pivots)), lists(_distances(as_anchor, pivots))], names=["id", "label", "v", "n2", "far", "asked"])

    return run


class _Cell:
    """One shard of rows against one group of anchors: tiles of exact scores where the brackets leave a chance.

    Rows are sorted by their nearest pivot, so that a tile's rows lie in one region.
    """

    def __init__(self, anchors: pa.Table, rows: pa.Table, greatest: int, width: int):
        self.a_id, self.a_label = anchors["id"].to_numpy(), anchors["label"].to_numpy()
        far = _matrix(rows["far"], np.float64)
        near = np.argmin(far, axis=1)
        order = np.lexsort((far[np.arange(len(far)), near], near))
        self.far, self.id, self.label = far[order], rows["id"].to_numpy()[order], rows["label"].to_numpy()[order]
        v, a = _matrix(rows["v"], np.int64, width)[order], _matrix(anchors["v"], np.int64, width)
        kind = np.float64 if greatest < EXACT else np.int64
        self.v, self.a = v.astype(kind), a.astype(kind)
        self.asked = _matrix(anchors["asked"], np.float64)
        self.base = anchors["n2"].to_numpy().astype(np.float64) + float(greatest)
        #: The brackets are widened by what rounding can have moved them.
        self.slack = 1e-9 * (float(greatest) + float(self.base.max(initial=0))) + 1e-6

    def tiles(self) -> Iterator[tuple[slice, slice]]:
        for a in range(0, len(self.a), ANCHORS):
            for r in range(0, len(self.v), TILE):
                yield slice(a, a + ANCHORS), slice(r, r + TILE)

    def of_tile(self, a: np.ndarray, r: slice) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score that each anchor can have with any row of a tile."""
        low, high = self.far[r].min(0), self.far[r].max(0)
        near = np.maximum(np.maximum(low - self.asked[a], self.asked[a] - high), 0).max(1)
        return self._scores(a, near, (self.asked[a] + high).min(1))

    def of_rows(self, a: np.ndarray, r: slice) -> tuple[np.ndarray, np.ndarray]:
        """The same of each anchor and row."""
        near, far = np.zeros((len(a), len(self.far[r]))), np.full((len(a), len(self.far[r])), np.inf)
        for p in range(self.far.shape[1]):
            x, y = self.asked[a, p][:, None], self.far[r, p]
            np.maximum(near, np.abs(x - y), out=near)
            np.minimum(far, x + y, out=far)
        return self._scores(a, near, far)

    def _scores(self, a: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = self.base[a] if near.ndim == 1 else self.base[a][:, None]
        return (base - far * far) / 2 - self.slack, (base - near * near) / 2 + self.slack

    def exact(self, a: np.ndarray, r: slice, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in a, row, score) of the pairs left."""
        i, j = np.nonzero(left)
        if len(i) * 8 > left.size:
            s = (self.a[a] @ self.v[r].T)[i, j]
        else:
            s = (self.a[a[i]] * self.v[r.start + j]).sum(1)
        return i, r.start + j, s.astype(np.int64)


def _best(group: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group: greater scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    first = np.searchsorted(g, g, side="left")
    return order[np.arange(len(g)) - first < k]


def _positives(greatest: int, width: int, k: int) -> Callable[..., pa.Table]:
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        c = _Cell(anchors, rows, greatest, width)
        n = len(c.a)
        held = [np.zeros(0, np.int64)] * 3  # anchor, row, score
        least = np.full(n, -np.inf)  # of the k-th found so far
        for at, r in c.tiles():
            a = np.arange(at.start, min(at.stop, n))
            a = a[c.of_tile(a, r)[1] >= least[a]]
            if not len(a):
                continue
            left = (c.a_label[a][:, None] == c.label[r]) & (c.a_id[a][:, None] != c.id[r]) & (c.of_rows(a, r)[1] >= least[a][:, None])
            i, j, s = c.exact(a, r, left)
            new = [np.concatenate(x) for x in zip(held, (a[i], j, s))]
            keep = _best(new[0], c.id[new[1]], new[2], k)
            held = [x[keep] for x in new]
            full = np.bincount(held[0], minlength=n) >= k
            lowest = np.full(n, np.inf)
            np.minimum.at(lowest, held[0], held[2])
            least[full] = lowest[full]
        return pa.table({"anchor_id": c.a_id[held[0]], "positive_id": c.id[held[1]], "positive_score": held[2]})

    return cell


def _negatives(greatest: int, width: int, k: int, low: int, high: int) -> Callable[..., pa.Table]:
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        c = _Cell(anchors, rows, greatest, width)
        n = len(c.a)
        scores, wide = anchors["scores"], int(anchors["scores"].combine_chunks().value_lengths().to_numpy().max(initial=0))
        many = scores.combine_chunks().value_lengths().to_numpy()
        positive = _matrix(scores, object, wide)  # whole numbers of any size: hundredfold scores may leave 64 bits
        there = np.arange(wide) < many[:, None]
        bottom = np.where(there, -((-low * positive) // 100), 1).astype(np.float64 if greatest < EXACT else np.int64)
        top = np.where(there, (high * positive) // 100, 0).astype(bottom.dtype)
        held = [np.zeros(0, np.int64)] * 3  # anchor * wide + positive, row, score
        least = bottom.astype(np.float64)  # what a new one must reach
        for at, r in c.tiles():
            a = np.arange(at.start, min(at.stop, n))
            lo, hi = c.of_tile(a, r)
            a = a[((hi[:, None] >= least[a]) & (lo[:, None] <= top[a]) & (bottom[a] <= top[a])).any(1)]
            if not len(a):
                continue
            lo, hi = c.of_rows(a, r)
            other = c.a_label[a][:, None] != c.label[r]
            left = np.zeros(other.shape, bool)
            for p in range(wide):
                left |= (hi >= least[a, p][:, None]) & (lo <= top[a, p][:, None]) & (bottom[a, p] <= top[a, p])[:, None]
            i, j, s = c.exact(a, r, left & other)
            found = []
            for p in range(wide):
                ok = np.flatnonzero((s >= least[a[i], p]) & (s >= bottom[a[i], p]) & (s <= top[a[i], p]))
                found.append((a[i[ok]] * wide + p, j[ok], s[ok]))
            new = [np.concatenate(x) for x in zip(held, *found)]
            keep = _best(new[0], c.id[new[1]], new[2], k)
            held = [x[keep] for x in new]
            full = np.bincount(held[0], minlength=n * wide) >= k
            lowest = np.full(n * wide, np.inf)
            np.minimum.at(lowest, held[0], held[2])
            least.reshape(-1)[full] = lowest[full]
        ids = _matrix(anchors["positives"], np.int64, wide)
        own = _matrix(scores, np.int64, wide)
        a, p = held[0] // max(wide, 1), held[0] % max(wide, 1)
        return pa.table({"anchor_id": c.a_id[a], "positive_id": ids[a, p], "positive_score": own[a, p], "negative_id": c.id[held[1]], "negative_score": held[2]})

    return cell


def _in_cells(anchors: DataFrame, rows: DataFrame, groups: int, shards: int, cell: Callable[..., pa.Table], schema: str) -> DataFrame:
    """Every group of anchors with every shard of rows, a task's call for each pair."""
    kind = pa.schema([(part.split()[0], pa.int64()) for part in schema.split(", ")])
    names = anchors.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return cell(left.select([f"a_{c}" for c in names]).rename_columns(names), right).cast(kind) if left.num_rows and right.num_rows else kind.empty_table()

    # Both sides come from one table: other names keep their columns apart.
    anchors = anchors.select(*[F.col(c).alias(f"a_{c}") for c in names])
    a = anchors.withColumn("a_g", F.pmod(F.xxhash64("a_id"), F.lit(groups))).withColumn("a_s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    r = rows.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return a.groupBy("a_g", "a_s").cogroup(r.groupBy("g", "s")).applyInArrow(run, schema)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, pivots: int = PIVOTS, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``usable_rows``.

    ``anchors`` says which rows (by id and label) are anchors.  Each one's first
    ``positives`` other rows of its label are its positives; for each, the first
    ``negatives`` of other labels with low * positive <= 100 * negative <= high * positive.
    """
    spark = rows.sparkSession
    base = core.checkpoint(rows)
    n, n_anchors, greatest, width = base.agg(F.count("*"), F.count(F.when(anchors, 1)), F.max("n2"), F.max(F.size("v"))).first()
    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    if not n_anchors:
        return spark.createDataFrame([], schema).select("anchor_id", "positive_id", F.lit(0).alias("rank"), "negative_id", "positive_score", "negative_score")
    sample = base.select("id", "v", "n2").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    at = pick_pivots(_augmented(_matrix(sample["v"], np.int64, width), sample["n2"].to_numpy(), greatest), pivots)
    table = core.checkpoint(base.mapInArrow(_table(at, greatest, width), f"{ROWS}, far array<double>, asked array<double>"))
    core.release(base)
    shards = max(-(-n // shard), min(2 * core.partitions(spark), -(-n // SMALL)))
    groups = -(-n_anchors // group)
    asked = table.filter(anchors).select("id", "label", "v", "n2", "asked")
    held = table.select("id", "label", "v", "n2", "far")
    found = _in_cells(asked, held, groups, shards, _positives(greatest, width, positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    first = lambda keys, score, other, k: Window.partitionBy(*keys).orderBy(F.desc(score), other)
    best = found.withColumn("k", F.row_number().over(first(["anchor_id"], "positive_score", "positive_id", positives))).filter(F.col("k") <= positives)
    per = best.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("k", "positive_id", "positive_score"))).alias("p"))
    ranged = core.checkpoint(asked.join(per.select("id", F.col("p.positive_id").alias("positives"), F.col("p.positive_score").alias("scores")), "id"))
    hits = _in_cells(ranged, held, groups, shards, _negatives(greatest, width, negatives, low, high), schema)
    rank = F.row_number().over(first(["anchor_id", "positive_id"], "negative_score", "negative_id", negatives))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th row of ``embeddings``; where vec_id is divisible by 7 the label is the next one."""
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable_rows(core.table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", moved)
    return mine(rows, F.col("id") % 50 == 0)


def negatives_sql() -> str:
    """The same in DuckDB: every anchor held against every row."""
    return f"""
WITH r AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a, r b WHERE a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}"""
