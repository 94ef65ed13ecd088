"""Near duplicates by min-max hashing, with every link confirmed on full sets.

Each document becomes its set of 5-word shingles.  Under every permutation both
the least and the greatest value are kept, so 110 hash evaluations give 220
signature values, and runs of five of them are bands.  Documents of equal sets
are one class from then on.

Links are found in steps.  (1) In every bucket, members link to a leader of a
compatible size, and these stars are confirmed on the full sets.  (2) Components
are formed of the confirmed links.  (3) Members of one bucket that are in
different components by now meet in blocks, with their sets: each pair, in the
first band it shares, is estimated by signature and, if within five deviations of
the threshold, decided on the full sets.  Only links go on, and components are
formed again.  So a group of thousands of copies costs its size,
not its square.

Small sets, of up to ``SMALL`` shingles, and all sets where ``exact`` is asked for, are
also found by their prefixes: of n shingles in the order of their hashes the first
n - ceil(0.75 n) + 1, of which two sets that are linked share one.  Pairs found so are
decided on the full sets without an estimate, so no link is lost.  A link between
larger sets is lost only if all 44 bands miss (about 1 in 100,000 at a similarity of
0.75, far less above) or the estimate errs by five deviations.

Sets hold 64-bit hashes of shingles; two shingles of one hash count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .components import components

PERMUTATIONS = 110
ROWS = 5
SHINGLE = 5
THRESHOLD = 75
#: Rows of a bucket that are compared at a time.
BLOCK = 2048
#: Sets of so many shingles are found exactly, through their prefixes.
SMALL = 24
#: Members of a star whose sets one task compares with the leader's.
SALT = 256
#: Signatures in a file.
SIGNED_ROWS = 20_000


def _constants(n: int) -> np.ndarray:
    """Odd multipliers of the permutations."""
    return core.mix(np.arange(1, n + 1, dtype=np.uint64) * core._C2) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z are lower-cased, nulls are empty."""
    raw, off = core.joined(texts.fill_null(""))
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    start, end, row = core.words_of(raw, off)
    h = core.word_hashes(raw, start, end)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    full = core.grams(h, width)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = hi - lo
        if n >= width:
            out.append(np.unique(full[lo : hi - width + 1]))
        elif n:
            out.append(core.grams(h[lo:hi], n, n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """For each non-empty set the high 16 bits' mix of the least and greatest value under each permutation."""
    full = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), 2 * permutations), np.uint16)
    for k, a in enumerate(_constants(permutations)):
        v = full * a
        out[:, 2 * k] = core.mix(np.minimum.reduceat(v, at)).astype(np.uint16)
        out[:, 2 * k + 1] = core.mix(np.maximum.reduceat(v, at)).astype(np.uint16)
    return out


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash of each band of each signature."""
    n = sig.shape[1] // rows
    parts = sig[:, : n * rows].reshape(len(sig), n, rows).astype(np.uint64)
    h = np.arange(1, n + 1, dtype=np.uint64)[None, :] * core._C1
    for r in range(rows):
        h = (h ^ (h >> np.uint64(31))) * core._C2 + parts[:, :, r] * core._C1
    return core.mix(h)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most about a megabyte of text."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 20), "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def prefix(s: np.ndarray, threshold: int) -> np.ndarray:
    """The least values of a sorted set, of which every set so similar shares one, as bands."""
    return core.mix(s[: len(s) - -(-len(s) * threshold // 100) + 1] + core._C1)


def _features(width: int, permutations: int, threshold: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401
        import xxhash

        for batch in batches:
            for part in _parts(batch):
                sets = shingle_sets(part.column("text"), width)
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full, permutations)) if full else iter(())
                digest, rows, heads = [], [], []
                for s in sets:
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    rows.append(next(sig).tobytes() if len(s) else None)
                    heads.append(prefix(s, threshold).tobytes() if len(s) and (exact or len(s) <= SMALL) else b"")
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(digest, pa.binary()), pa.array(rows, pa.binary()), pa.array(heads, pa.binary())], ["id", "n", "digest", "sig", "head"])

    return run


def _deal(n_parts: int, rows: int):
    """Packed (band, vertex, size) for each part of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                if not batch.num_rows:
                    continue
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                h = bands(sig, rows)
                heads = batch.column("head").to_pylist()
                who = np.concatenate([np.repeat(np.arange(len(h)), h.shape[1]), np.repeat(np.arange(len(h)), [len(x) // 8 for x in heads])])
                h = np.concatenate([h.ravel(), np.frombuffer(b"".join(heads), np.uint64)])
                v, n = (batch.column(c).to_numpy(zero_copy_only=False)[who] for c in ("v", "n"))
                order = np.argsort(h, kind="stable")
                h, v, n = h[order], v[order], n[order]
                full = [(p, slice(lo, hi)) for p, lo, hi in core.filled(h, n_parts)]
                blobs = [h[s].tobytes() + v[s].astype("<i8").tobytes() + n[s].astype("<u4").tobytes() for _, s in full]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in full], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    return run


def _shared(t: pa.Table) -> pa.Table:
    """The entries (band, vertex, size) of a part whose band has two members or more."""
    cols: list[list[np.ndarray]] = [[], [], []]
    for b in t["blob"].to_pylist():
        n = len(b) // 20
        for c, dt, at in zip(cols, ("<u8", "<i8", "<u4"), (0, 8 * n, 16 * n)):
            c.append(np.frombuffer(b, dt, n, at))
    h, v, size = (np.concatenate(c) for c in cols)
    order = np.argsort(h, kind="stable")
    h, v, size = h[order], v[order], size[order]
    same = h[1:] == h[:-1]
    many = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return pa.table({"band": pa.array(h[many].view(np.int64), pa.int64()), "v": pa.array(v[many], pa.int64()), "n": pa.array(size[many].astype(np.int64), pa.int64())})


def _sorted(t: pa.Table, *columns: str) -> list[np.ndarray]:
    """Columns of a part's entries, by band and vertex."""
    cols = [t[c].to_numpy() for c in ("band", "v", *columns)]
    order = np.lexsort((cols[1], cols[0]))
    return [c[order] for c in cols]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    a, b = np.minimum(a, b), np.maximum(a, b)
    keep = a != b
    a, b = a[keep], b[keep]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.table({"a": pa.array(a[new], pa.int64()), "b": pa.array(b[new], pa.int64())})


def _fits(x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sets of these sizes can be so similar."""
    return np.minimum(x, y) * 100 >= np.maximum(x, y) * threshold


def _stars(threshold: int):
    def run(t: pa.Table) -> pa.Table:
        h, v, size = _sorted(t, "n")
        a, b = [], []
        while len(h):
            new = np.concatenate([[True], h[1:] != h[:-1]])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            fits = _fits(size, size[lead], threshold)
            a.append(v[lead[fits]])
            b.append(v[fits])
            h, v, size = h[~fits], v[~fits], size[~fits]
        return _pairs(np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64))

    return run


def _sections(f: int, n: int, label: np.ndarray) -> list[tuple[np.ndarray, bool]]:
    """Blocks of a bucket's members (of least to greatest set), and whether all of one are in one component.

    A component of a block's size or more has blocks of its own; the others share theirs.
    """
    own = np.arange(f, f + n)
    names, of, count = np.unique(label[own], return_inverse=True, return_counts=True)
    large = np.flatnonzero(count >= BLOCK)
    parts = [(own[of == c], True) for c in large.tolist()]
    rest = own[~np.isin(of, large)]
    parts += [(rest, len(np.unique(label[rest])) == 1)] if len(rest) else []
    return [(part[at : at + BLOCK], pure) for part, pure in parts for at in range(0, len(part), BLOCK)]


def _split(t: pa.Table, threshold: int = THRESHOLD) -> pa.Table:
    """Members of buckets that still hold several components, dealt to pairs of blocks.

    Blocks follow the sets' sizes, so only those near the diagonal can hold a link; two blocks
    of one component are no pair.
    """
    h, v, label, n_of = (t[c].to_numpy() for c in ("band", "v", "label", "n"))
    order = np.lexsort((v, n_of, h))
    h, v, label, n_of = h[order], v[order], label[order], n_of[order]
    if not len(h):
        return pa.table({"block": pa.array([], pa.binary()), "side": pa.array([], pa.int32()), "v": pa.array([], pa.int64()), "label": pa.array([], pa.int64())})
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    low, high = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
    size = np.diff(np.append(first, len(h)))
    block, side, who = [], [], []
    for f, n in zip(first[low < high].tolist(), size[low < high].tolist()):
        head = h[f].tobytes()
        parts = _sections(f, n, label)
        for i, (x, pure_x) in enumerate(parts):
            for j, (y, pure_y) in enumerate(parts[i:], i):
                if pure_x and pure_y and label[x[0]] == label[y[0]]:
                    continue
                # The greatest set of one against the least of the other.
                if min(n_of[x[-1]], n_of[y[-1]]) * 100 < max(n_of[x[0]], n_of[y[0]]) * threshold:
                    continue
                name = head + bytes([i & 255, i >> 8, j & 255, j >> 8])
                for k, own in enumerate((x, y) if i < j else (x,)):
                    block += [name] * len(own)
                    side += [k] * len(own)
                    who.append(own)
    at = np.concatenate(who) if who else np.zeros(0, np.int64)
    return pa.table({"block": pa.array(block, pa.binary()), "side": pa.array(side, pa.int32()), "v": pa.array(v[at], pa.int64()), "label": pa.array(label[at], pa.int64())})


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Values that two sorted sets share."""
    at = np.searchsorted(x, y)
    return int((x[np.minimum(at, len(x) - 1)] == y).sum())


def _between(threshold: int, values: int, rows: int):
    """Links between members of different components, pair by pair within each block; only confirmed ones go on.

    A pair is looked at in the first band it shares, if its estimate is within
    five deviations of the threshold, or in a prefix that it shares, and decided on
    the full sets.
    """
    p = threshold / 100
    least = values * p - 5 * (values * p * (1 - p)) ** 0.5

    def compare(band: np.int64, x: tuple, y: tuple, same: bool, a: list, b: list) -> None:
        (vx, lx, nx, sx, hx, fx), (vy, ly, ny, sy, hy, fy) = x, y
        for i in range(len(vx)):
            first = i + 1 if same else 0
            k = np.flatnonzero((ly[first:] != lx[i]) & _fits(ny[first:], nx[i], threshold)) + first
            # In a prefix every pair is decided; of other bands, in the first that both have.
            if (hx[i] == band.view(np.uint64)).any():
                k = k[(sy[k] == sx[i]).sum(1) >= least]
                equal = hy[k] == hx[i]
                k = k[hx[i][equal.argmax(1)].view(np.int64) == band]
            for m in k.tolist():
                both = _common(fx[i], fy[m])
                if both * 100 >= (len(fx[i]) + len(fy[m]) - both) * threshold:
                    a.append(vx[i])
                    b.append(vy[m])

    def run(t: pa.Table) -> pa.Table:
        a: list = []
        b: list = []
        t = t.sort_by([("block", "ascending"), ("side", "ascending"), ("v", "ascending")])
        blocks, side = t["block"].to_pylist(), t["side"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(len(blocks), -1)
        full = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
        cols = (t["v"].to_numpy(), t["label"].to_numpy(), t["n"].to_numpy(), sig, bands(sig, rows))
        lo = 0
        while lo < len(blocks):
            hi = lo
            while hi < len(blocks) and blocks[hi] == blocks[lo]:
                hi += 1
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            x = (*(c[lo:mid] for c in cols), full[lo:mid])
            same = blocks[lo][8:10] == blocks[lo][10:12]
            compare(np.frombuffer(blocks[lo], np.int64, 1)[0], x, x if same else (*(c[mid:hi] for c in cols), full[mid:hi]), same, a, b)
            lo = hi
        return _pairs(np.array(a, np.int64), np.array(b, np.int64))

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in _parts(batch):
                sets = shingle_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["v", "shingles"])

    return run


def _confirm(threshold: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        leaders = [np.frombuffer(b, np.uint64) for b in left["shingles"].to_pylist()]
        yes = []
        for b, blob in zip(right["b"].to_pylist(), right["shingles"].to_pylist()):
            y = np.frombuffer(blob, np.uint64)
            for x in leaders:
                both = _common(x, y)
                if both * 100 >= (len(x) + len(y) - both) * threshold:
                    yes.append(b)
                    break
        a = left["v"][0].as_py() if len(left) else None
        return pa.table({"a": pa.array([a] * len(yes), pa.int64()), "b": pa.array(yes, pa.int64())})

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD, most: int | None = None) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    A pair's second set goes to the first's; a vertex with many pairs is salted,
    its own set sent to each salt.  ``most`` bounds the vertices, if it is known.
    """
    # From files, so that both sides of the join below are plain exchanges, which adaptive execution splits where a vertex has many pairs.
    degree = core.checkpoint(pairs.groupBy("a").agg(F.count("*").alias("deg")), most)
    salts = degree.select("a", F.explode(F.sequence(F.lit(0), F.floor(F.col("deg") / SALT).cast("int"))).alias("salt"), "deg")
    left = salts.join(sets, salts["a"] == sets["v"]).select("v", "salt", "shingles")
    # The salt hangs on b alone, so both sides agree.
    right = (
        pairs.join(degree, "a")
        .select("a", "b", F.pmod(F.xxhash64("b"), F.floor(F.col("deg") / SALT) + 1).cast("int").alias("salt"))
        .join(sets.toDF("w", "other"), F.col("b") == F.col("w"))
        .select("a", "salt", "b", F.col("other").alias("shingles"))
    )
    return left.groupBy("v", "salt").cogroup(right.groupBy("a", "salt")).applyInArrow(_confirm(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, width: int = SHINGLE, permutations: int = PERMUTATIONS, rows: int = ROWS, exact: bool = False) -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable), kept; one row for each input row.

    Two documents are linked if 100 * intersection >= threshold * union of their
    sets of ``width``-word shingles; with fewer words the whole sequence is the one
    shingle.  A document without words is linked with nothing.  ``exact`` finds all sets
    by their prefixes too, so that no link at all is lost, at some twice the entries.

    Nulls: a null text has no words; a row whose id is null takes no part (null
    component_id, kept).  Rows of one id and one text are one document; an id with
    several texts is one vertex for each of them unless it leads a class of copies.
    Texts of any length are taken whole, in Arrow's 64-bit offsets.  An empty table
    gives none; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    feats = core.checkpoint(rows_in.mapInArrow(_features(width, permutations, threshold, exact), "id long, n long, digest binary, sig binary, head binary"))
    real = feats.filter("digest IS NOT NULL AND id IS NOT NULL")
    # One vertex for each set; copies are counted before the shuffle.
    classes = real.groupBy("digest").agg(F.min("id").alias("v"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("head").alias("head"))
    classes = core.checkpoint(classes)
    n_classes, n_bands = classes.count(), 2 * permutations // rows
    n_parts = max(core.partitions(spark), n_classes * n_bands // 500_000)
    # A class has at most one star in each band, or in each value of its prefix.
    n_stars = None if exact else n_classes * (n_bands + SMALL)

    dealt = classes.select("v", "n", "sig", "head").mapInArrow(_deal(n_parts, rows), "part int, blob binary").groupBy("part")
    # From here on only the entries of bands that several members share, and their signatures.
    entries = core.checkpoint(dealt.applyInArrow(_shared, "band long, v long, n long"))
    part = F.pmod(F.xxhash64("band"), F.lit(n_parts)).alias("part")
    stars = core.checkpoint(entries.select("*", part).groupBy("part").applyInArrow(_stars(threshold), "a long, b long").distinct(), n_stars)
    signed = core.checkpoint(classes.join(entries.select("v").distinct(), "v", "left_semi").select("v", "n", "sig"), n_classes, SIGNED_ROWS)
    wanted = signed.select(F.col("v").alias("id"))
    sets = core.checkpoint(rows_in.join(wanted, "id", "left_semi").mapInArrow(_sets(width), "v long, shingles binary").distinct())
    found = components(confirmed(stars, sets, threshold, n_classes), n_stars)
    labelled = entries.join(found, entries["v"] == found["vertex"], "left").select("band", "v", "n", F.coalesce("component", "v").alias("label"), part)
    # Bands that still hold members of several components.
    split = labelled.groupBy("part").applyInArrow(lambda t: _split(t, threshold), "block binary, side int, v long, label long")
    blocks = split.join(signed, "v").join(sets, "v").withColumn("home", F.pmod(F.xxhash64("block"), F.lit(8 * n_parts)))
    more = core.checkpoint(blocks.groupBy("home").applyInArrow(_between(threshold, 2 * permutations, rows), "a long, b long"))
    if more.limit(1).count():
        # One more row for each vertex says what it belongs to already.
        found = components(found.select(F.col("vertex").alias("a"), F.col("component").alias("b")).filter("a != b").unionByName(more))
    named = classes.join(found, classes["v"] == found["vertex"], "left").select("digest", F.coalesce("component", "v").alias("component_id"))
    out = feats.select("id", "n", "digest").join(named, "digest", "left")
    # A document without words is its own component.
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op9(spark, sf_dir):
    return near_duplicates(core.table(spark, sf_dir, "documents"))
