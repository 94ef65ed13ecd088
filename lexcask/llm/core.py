"""What the operators of this subpackage share.

Windows are found the same way for bytes and for words: a window's *anchor* is
the least hash among the short grams inside it (a minimizer), so equal windows
have equal anchors wherever they stand.  Documents are dealt into chunks of a
few megabytes; every exchange then moves one packed blob for each pair of chunk
and bucket, not one row for each position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Text bytes of one chunk, about; a chunk is the unit that one Python call holds.
CHUNK_BYTES = 2 << 20
#: Positions hashed at a time, so that the arrays stay in the processor's cache.
BLOCK = 1 << 15
#: The id that stands for a null one: after every other.
NULL_ID = (1 << 63) - 1

_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xC2B2AE3D27D4EB4F)
_U32 = np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer over unsigned 64-bit values (multiply and shift)."""
    h = h ^ (h >> _U32)
    h = h * _C1
    h ^= h >> np.uint64(29)
    h *= _C2
    h ^= h >> _U32
    return h


def spread(least: np.ndarray) -> np.ndarray:
    """Anchors over the whole range: the least of many hashes are small, so they are mixed once more (one to one)."""
    return mix(least + _C2)


def slide(op, a: np.ndarray, width: int) -> np.ndarray:
    """``op`` (minimum or maximum) over every run of ``width`` neighbours."""
    n = 1
    while n * 2 <= width:
        a = op(a[:-n], a[n:])
        n *= 2
    return op(a[: -(width - n)], a[width - n :]) if n < width else a


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a table of fewer splits than there are cores, dealt out; a table of enough splits stays where it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def chunks_of(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int, int]:
    """(chunk, id, text, row, carried columns) with documents dealt by a hash; the number of chunks and of buckets.

    Both numbers follow the corpus's bytes, so a chunk and a bucket stay of one
    size as it grows.  The hash is of id and text, so rows without an id, or of one
    repeated id, are dealt out as others are.  Nulls: a null text is empty, a null id
    comes after all ids.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    p = partitions(spark)
    n_chunks = max(2 * p, -(-total // CHUNK_BYTES))
    n_buckets = max(p, -(-total // (8 * CHUNK_BYTES)))
    key = F.coalesce(F.col(id_col), F.lit(NULL_ID))
    kept = [F.col(c).alias(f"__c_{c}") for c in carry]
    out = docs.select(
        F.pmod(F.xxhash64(key, F.col(text_col)), F.lit(n_chunks)).cast("int").alias("chunk"),
        key.cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *kept,
    )
    return out, n_chunks, n_buckets


def with_carried(ddl: str, texts: DataFrame, carry: tuple[str, ...]) -> StructType:
    """A schema and the carried columns after it."""
    return StructType(StructType.fromDDL(ddl).fields + [StructField(f"__c_{c}", texts.schema[f"__c_{c}"].dataType) for c in carry])


def joined(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array, and where each starts (with the end)."""
    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], texts.type)
    arr = arr.cast(pa.large_binary())
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


#: Mixed values of the 256 bytes, for word hashes.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _C2)
_B = 0xD6E8FEB86659FD93
_BINV = pow(_B, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[str, np.ndarray] = {}


def _pow(name: str, base: int, n: int) -> np.ndarray:
    if len(_POW.get(name, ())) < n:
        _POW[name] = _powers(base, max(n, BLOCK * 4))
    return _POW[name][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word ``[^\\x20\\x09-\\x0D]+``; words never cross documents."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    return start, end, doc


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over mixed byte values, the length mixed in.

    Words of over 64 bytes are hashed by xxh3, as polynomials modulo a power of
    two are weak on very long strings.
    """
    import xxhash

    n = len(raw)
    if not len(start):
        return np.zeros(0, np.uint64)
    # In blocks, with powers that start anew in each; words that cross a block's end are hashed apart.
    out = np.empty(len(start), np.uint64)
    size = BLOCK
    p, q = _pow("b", _B, size), _pow("i", _BINV, size)
    lo = 0
    crossing = (start // size) != ((end - 1) // size)
    for at in range(0, n, size):
        part = raw[at : at + size]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * p[: len(part)], out=sums[1:])
        hi = np.searchsorted(start, at + len(part))
        s, e = start[lo:hi] - at, np.minimum(end[lo:hi] - at, len(part))
        out[lo:hi] = (sums[e] - sums[s]) * q[s]
        lo = hi
    out += (end - start).astype(np.uint64) * _C1
    out = mix(out)
    for i in np.flatnonzero((end - start > 64) | crossing):
        w = raw[start[i] : end[i]]
        if len(w) > 64:
            out[i] = xxhash.xxh3_64_intdigest(w.tobytes())
        else:
            h = int((_BYTE[w] * p[: len(w)]).sum(dtype=np.uint64))
            out[i] = mix(np.array([(h + len(w) * int(_C1)) & (2**64 - 1)], np.uint64))[0]
    return out


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """The hash of every ``n`` neighbouring values (empty if there are fewer), by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    c = np.uint64((0xA0761D6478BD642F + 2 * salt) | 1)
    parts, width, cur, rest, at = [], 1, h * c if salt else h, n, 0
    while rest:
        if rest & 1:
            parts.append((at, cur))
            at += width
        rest >>= 1
        if rest:
            nxt = cur[:-width] * c
            nxt = nxt ^ (nxt >> _U32)
            cur = nxt * _C1 + cur[width:]
            width *= 2
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for shift, part in parts:
        out = (out ^ (out >> _U32)) * _C2 + part[shift : shift + m]
    return mix(out)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets in the order of the hashes, so a sorted array falls into slices."""
    return ((h >> _U32) * np.uint64(n)) >> _U32


def filled(sorted_hashes: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) in sorted hashes of each bucket that holds any, so work follows the hashes, not the buckets."""
    b, first = np.unique(bucket_of(sorted_hashes, n), return_index=True)
    return list(zip(b.tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_hashes)]))


def pack6(h: np.ndarray) -> bytes:
    """The 48 high bits of each hash."""
    return np.ascontiguousarray(h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack6(b: bytes) -> np.ndarray:
    x = np.zeros((len(b) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return x.reshape(-1).view(">u8").astype(np.uint64)


#: An anchor found so often is hot: its windows are dealt out one by one.
HOT = 4096


def anchor_rows(chunk: int, found: np.ndarray, n_buckets: int) -> pa.Table:
    """One row for each bucket: the chunk's distinct anchors and how often each was found (where twice or more)."""
    u, cnt = np.unique(found & np.uint64(0xFFFFFFFFFFFF0000), return_counts=True)
    rows = filled(u, n_buckets)
    more = [np.flatnonzero(cnt[lo:hi] > 1).astype("<u4") for _, lo, hi in rows]
    return pa.table(
        {
            "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
            "chunk": pa.array([chunk] * len(rows), pa.int32()),
            "blob": pa.array([pack6(u[lo:hi]) for _, lo, hi in rows], pa.binary()),
            "more": pa.array([m.tobytes() + np.minimum(cnt[lo:hi][m], 1 << 30).astype("<u4").tobytes() for (_, lo, hi), m in zip(rows, more)], pa.binary()),
        }
    )


ANCHORS = "bucket int, chunk int, blob binary, more binary"
REPEATS = "chunk int, bucket int, bits binary"


def repeated(t: pa.Table) -> pa.Table:
    """For each chunk the anchors of this bucket found elsewhere or twice; two bits each: repeated, hot."""
    blobs, more = t["blob"].to_pylist(), t["more"].to_pylist()
    vals = [unpack6(b) for b in blobs]
    counts = []
    for v, m in zip(vals, more):
        c = np.ones(len(v), np.int64)
        k = len(m) // 8
        c[np.frombuffer(m, "<u4", k)] = np.frombuffer(m, "<u4", k, 4 * k)
        counts.append(c)
    allv, allc = np.concatenate(vals), np.concatenate(counts)
    order = np.argsort(allv, kind="stable")
    s = allv[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    group = np.cumsum(first) - 1
    total = np.add.reduceat(allc[order], np.flatnonzero(first))
    bits = np.empty(len(allv), np.int64)
    bits[order] = total[group]
    out, at = [], 0
    for v in vals:
        b = bits[at : at + len(v)]
        at += len(v)
        out.append(np.packbits(b > 1).tobytes() + np.packbits(b > HOT).tobytes())
    return pa.table({"chunk": t["chunk"].cast(pa.int32()), "bucket": t["bucket"].cast(pa.int32()), "bits": pa.array(out, pa.binary())})


def repeat_flags(found: np.ndarray, n_buckets: int, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Whether each found anchor is repeated, and whether it is hot, from the buckets' replies to this chunk."""
    cut = found & np.uint64(0xFFFFFFFFFFFF0000)
    u, inv = np.unique(cut, return_inverse=True)
    at = {b: (lo, hi) for b, lo, hi in filled(u, n_buckets)}
    rep, hot = np.zeros(len(u), bool), np.zeros(len(u), bool)
    for b, bits in zip(replies["bucket"].to_pylist(), replies["bits"].to_pylist()):
        lo, hi = at[b]
        k = -(-(hi - lo) // 8)
        rep[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8, k), count=hi - lo)
        hot[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8, k, k), count=hi - lo)
    return rep[inv], hot[inv]


#: Rows of a checkpoint's file, where a bound of them is known.
FILE_ROWS = 500_000


def checkpoint(df: DataFrame, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """The same rows from files in the cluster's shared checkpoint folder (spark.checkpoint.dir).

    If there are known to be at most ``rows``, there are no more files than one for
    ``each`` so many: an iteration over few rows does not write a file a partition.

    Where that is unset, one machine's session uses a folder of its own, as in tests;
    on a cluster, whose machines could not read it, that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            import tempfile

            shared = tempfile.mkdtemp(prefix="lexcask-checkpoint-")
        sc.setCheckpointDir(shared)
    return (df if rows is None else df.coalesce(max(1, -(-rows // each)))).checkpoint()


def release(df: DataFrame) -> None:
    """Removes a checkpoint's files, once nothing reads them any more."""
    jvm = df.sparkSession._jvm
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
