"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

Suffixes are taken where they can matter.  Each 50-byte window has an anchor, its
least 16-byte gram by hash; a first exchange of packed anchor hashes finds the
anchors that occur more than once, and only windows over those are kept.  The
neighbouring windows over one anchor are one *suffix* of up to 84 bytes.  Each
chunk sorts its suffixes (led by the anchor's hash, so ranges of hashes deal them
out evenly), drops equal ones, and sends sorted, front-coded runs.  A merge task
combines its runs with a loser tree whose nodes hold the length of the common
prefix with the last winner: a longer one wins unread, and only at equal lengths
are bytes compared, from that length on.  The merged order shows equal suffixes
at once; suffixes that share an anchor but differ are opened into their windows.

An anchor found over ``core.HOT`` times (a line that many documents hold, amid
different text) is dealt out by whole windows, so no task has all of it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import core

_ZLEVEL = 1


def _zip(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=_ZLEVEL).compress(b)


def _unzip(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


def ordered(t: pa.Table) -> pa.Table:
    """A chunk's rows in an order that does not hang on how they arrived."""
    return t.sort_by([("id", "ascending"), ("text", "ascending")])


def byte_suffixes(raw: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end of windows and anchor of each run of windows with one anchor, within documents."""
    n, wide = len(raw), length - gram + 1
    nw = n - length + 1
    if nw <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    least = np.empty(nw, np.uint64)
    tail = gram - 8
    for at in range(0, nw, core.BLOCK):
        hi = min(nw, at + core.BLOCK)
        x = raw[at : hi + length - 1]
        eight = np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (len(x) - 7, 8), (1, 1))).view(np.uint64).ravel()
        h = core.mix(eight[: len(eight) - tail] * core._C1 + (eight[tail:] ^ (eight[tail:] >> np.uint64(31))) * core._C2)
        least[at:hi] = core.slide(np.minimum, h, wide)
    gone = np.zeros(n + 1, np.int32)
    np.add.at(gone, np.maximum(off[1:] - length + 1, off[:-1]), 1)
    np.add.at(gone, off[1:], -1)
    valid = np.cumsum(gone[:nw]) == 0
    edge = np.empty(nw, bool)
    edge[0] = True
    edge[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(edge)
    end = np.append(start[1:], nw)
    keep = valid[start]
    start, end = start[keep], end[keep]
    if len(start) and (end - start).max() > wide:
        parts = -(-(end - start) // wide)
        which = np.repeat(np.arange(len(start)), parts)
        k = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, end = start[which] + k * wide, np.minimum(start[which] + (k + 1) * wide, end[which])
    return start, end, core.spread(least[start])


def front_code(keys: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Common prefix with the key before, length, and all that is left of the keys."""
    lens = np.fromiter(map(len, keys), np.int64, len(keys))
    grid = np.frombuffer(b"".join([k.ljust(width, b"\0") for k in keys]), np.uint8).reshape(-1, width)
    lcp = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differ = grid[1:] != grid[:-1]
        first = differ.argmax(1)
        first[~differ.any(1)] = width
        lcp[1:] = np.minimum(first, np.minimum(lens[1:], lens[:-1]))
    col = np.arange(width)
    rest = grid[(col >= lcp[:, None]) & (col < lens[:, None])]
    return lcp.astype("<u2"), lens.astype("<u2"), rest.tobytes()


def pack_run(keys: list[bytes], docs: list[int], places: list[list[int]], width: int) -> bytes:
    lcp, lens, rest = front_code(keys, width)
    counts = np.fromiter(map(len, places), "<u4", len(places))
    flat = np.array([p for ps in places for p in ps], "<u4")
    head = np.array([len(keys), len(flat), len(rest)], "<u4")
    return _zip(b"".join([head.tobytes(), lcp.tobytes(), lens.tobytes(), np.array(docs, "<i8").tobytes(), counts.tobytes(), flat.tobytes(), rest]))


class Run:
    """A sorted front-coded run, decoded as it is read; the places of each of its keys."""

    def __init__(self, blob: bytes):
        self.data = b = _unzip(blob)
        n, m, _ = (int(x) for x in np.frombuffer(b, "<u4", 3))
        self.n, at, out = n, 12, []
        for code, k in (("H", n), ("H", n), ("q", n), ("I", n), ("I", m)):
            a = array(code)
            a.frombytes(b[at : at + k * a.itemsize])
            at += k * a.itemsize
            out.append(a)
        self.lcp, self.size, self.least, counts, self.places = out
        self.ends = array("q", [0, *accumulate(counts)])
        self.at, self.i, self.key = at, -1, b""
        self.next()

    def next(self) -> int:
        """Moves to the next key; its common prefix with the one before, or -1 at the end."""
        self.i += 1
        if self.i >= self.n:
            return -1
        c, end = self.lcp[self.i], self.at + self.size[self.i]
        end -= c
        self.key = self.key[:c] + self.data[self.at : end]
        self.at = end
        return c


def merge_runs(runs: list[Run]) -> Iterator[tuple[bytes, int, int, int]]:
    """(key, common prefix with the key before, run, index) in order, by a loser tree that knows prefixes."""
    size = 1
    while size < len(runs):
        size *= 2
    # The common prefix of a run's key with the key it last lost to (or, for the winner, with the last output); -1: run is over.
    known = [0 if r < len(runs) and runs[r].n else -1 for r in range(size)]
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes the one with the winner."""
        ha, hb = known[a], known[b]
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        if ha < 0:
            return a, b
        x, y = runs[a].key[ha:], runs[b].key[ha:]
        if x == y:
            known[b] = ha + len(x)
            return a, b
        i, n = 0, min(len(x), len(y))
        while i < n and x[i] == y[i]:
            i += 1
        if x < y:
            known[b] = ha + i
            return a, b
        known[a] = ha + i
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        w, lo = play(build(2 * node), build(2 * node + 1))
        loser[node] = lo
        return w

    win = build(1)
    while known[win] >= 0:
        run = runs[win]
        yield run.key, known[win], win, run.i
        known[win] = run.next()
        node = (win + size) >> 1
        while node:
            other = loser[node]
            ho, hw = known[other], known[win]
            if ho > hw:
                loser[node], win = win, other
            elif ho == hw and ho >= 0:
                win, loser[node] = play(win, other)
            node >>= 1


def _anchors(length: int, gram: int, n_buckets: int):
    def run(t: pa.Table) -> pa.Table:
        chunk = t["chunk"][0].as_py()
        raw, off = core.joined(ordered(t)["text"])
        return core.anchor_rows(chunk, byte_suffixes(raw, off, length, gram)[2], n_buckets)

    return run


def _runs(length: int, gram: int, n_buckets: int):
    width = 8 + length - gram + 1 + length - 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import xxhash

        out: dict[str, list] = {"part": [], "chunk": [], "blob": []}
        if len(left) and len(right):
            chunk = left["chunk"][0].as_py()
            t = ordered(left)
            raw, off = core.joined(t["text"])
            ids = t["id"].to_numpy()
            start, end, found = byte_suffixes(raw, off, length, gram)
            rep, hot = core.repeat_flags(found, n_buckets, right)
            buf = raw.tobytes()
            doc = ids[np.searchsorted(off, start, side="right") - 1]
            at: dict[bytes, list[int]] = {}
            least: dict[bytes, int] = {}

            def add(key: bytes, place: int, d: int) -> None:
                seen = at.get(key)
                if seen is None:
                    at[key] = [place]
                    least[key] = d
                else:
                    seen.append(place)
                    if d < least[key]:
                        least[key] = d

            plain = np.flatnonzero(rep & ~hot)
            lead = found[plain].astype(">u8").tobytes()
            for j, (s, e, d) in enumerate(zip(start[plain].tolist(), end[plain].tolist(), doc[plain].tolist())):
                add(lead[8 * j : 8 * j + 8] + buf[s : e + length - 1], s, d)
            many = np.flatnonzero(hot)
            for s, e, d in zip(start[many].tolist(), end[many].tolist(), doc[many].tolist()):
                for i in range(s, e):
                    w = buf[i : i + length]
                    add(xxhash.xxh3_64_digest(w) + w, i, d)
            keys = sorted(at)
            if keys:
                heads = np.frombuffer(b"".join([k[:8] for k in keys]), ">u8").astype(np.uint64)
                for p, lo, hi in core.filled(heads, n_buckets):
                    ks = keys[lo:hi]
                    out["part"].append(p)
                    out["chunk"].append(chunk)
                    out["blob"].append(pack_run(ks, [least[k] for k in ks], [at[k] for k in ks], width))
        return pa.table({"part": pa.array(out["part"], pa.int32()), "chunk": pa.array(out["chunk"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())})

    return run


def _merge(length: int):
    def run(t: pa.Table) -> pa.Table:
        chunks = t["chunk"].to_pylist()
        runs = [Run(b) for b in t["blob"].to_pylist()]
        said = [(array("I"), array("I"), array("q")) for _ in runs]

        def tell(r: int, i: int, windows: list) -> None:
            """Answers a run: at each place of its key, from a window on, so many windows begin in this document at the latest."""
            run = runs[r]
            lo, hi = run.ends[i], run.ends[i + 1]
            own = run.least[i]
            spots, count, doc = said[r]
            for o, k, m in windows:
                if m < own or hi - lo > 1:
                    for p in run.places[lo:hi]:
                        spots.append(p + o)
                        count.append(k)
                        doc.append(m)

        def close(group: list[tuple[bytes, list[tuple[int, int]]]]) -> None:
            if len(group) == 1:
                key, members = group[0]
                r, i = members[0]
                if len(members) > 1 or runs[r].ends[i + 1] - runs[r].ends[i] > 1:
                    m = min([runs[r].least[i] for r, i in members])
                    for r, i in members:
                        tell(r, i, [(0, len(key) - 7 - length, m)])
                return
            best: dict[bytes, int] = {}
            opened = []
            for key, members in group:
                m = min([runs[r].least[i] for r, i in members])
                ws = [key[o : o + length] for o in range(8, len(key) - length + 1)]
                for w in ws:
                    if best.setdefault(w, m) > m:
                        best[w] = m
                opened.append((ws, members))
            for ws, members in opened:
                spans, prev = [], None
                for o, w in enumerate(ws):
                    m = best[w]
                    if m == prev:
                        spans[-1][1] += 1
                    else:
                        spans.append([o, 1, m])
                        prev = m
                for r, i in members:
                    tell(r, i, spans)

        group: list = []
        for key, lcp, r, i in merge_runs(runs):
            if group and lcp == len(key) == len(group[-1][0]):
                group[-1][1].append((r, i))
                continue
            if group and lcp < 8:
                close(group)
                group = []
            group.append((key, [(r, i)]))
        if group:
            close(group)
        out_chunk, out_blob = [], []
        for chunk, (spots, count, doc) in zip(chunks, said):
            if spots:
                out_chunk.append(chunk)
                out_blob.append(_zip(np.array([len(spots)], "<u4").tobytes() + spots.tobytes() + count.tobytes() + doc.tobytes()))
        return pa.table({"chunk": pa.array(out_chunk, pa.int32()), "blob": pa.array(out_blob, pa.binary())})

    return run


def removed_runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs, in document coordinates, and how many each document has."""
    n = len(mask)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], mask[:-1]])
    after = np.concatenate([mask[1:], [False]])
    start = np.flatnonzero(mask & (~before | edge[:-1]))
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    return start - off[doc], end - off[doc], np.bincount(doc, minlength=len(off) - 1)


def whole_characters(mask: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The mask less every character of which only some bytes are removed."""
    if not len(raw):
        return mask
    lead = (raw & 0xC0) != 0x80
    lead[off[:-1][off[:-1] < len(raw)]] = True
    first = np.flatnonzero(lead)
    full = np.minimum.reduceat(mask, first)
    return np.repeat(full, np.diff(np.append(first, len(raw))))


def _apply(length: int, carry: tuple[str, ...], characters: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = ordered(left) if len(left) else left
        raw, off = core.joined(t["text"])
        ids = t["id"].to_numpy()
        cover = np.zeros(len(raw) + 1, np.int32)
        for blob in right["blob"].to_pylist():
            b = _unzip(blob)
            n = int(np.frombuffer(b, "<u4", 1)[0])
            pos = np.frombuffer(b, "<u4", n, 4).astype(np.int64)
            count = np.frombuffer(b, "<u4", n, 4 + 4 * n).astype(np.int64)
            m = np.frombuffer(b, "<i8", n, 4 + 8 * n)
            later = ids[np.searchsorted(off, pos, side="right") - 1] > m
            np.add.at(cover, pos[later], 1)
            np.add.at(cover, pos[later] + count[later] - 1 + length, -1)
        mask = np.cumsum(cover[:-1]) > 0
        if characters:
            mask = whole_characters(mask, raw, off)
        start, end, spans = removed_runs(mask, off)
        kept = raw[~mask].tobytes()
        ends = np.concatenate([[0], np.cumsum(~mask)])[off]
        bounds = np.concatenate([[0], np.cumsum(spans)]).astype(np.int32)
        struct = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
        out = {
            "id": t["id"].cast(pa.int64()),
            "n_bytes": pa.array(np.diff(off), pa.int64()),
            "spans": pa.ListArray.from_arrays(pa.array(bounds), struct),
            "kept": pa.array([kept[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()),
        }
        return pa.table(out | {f"__c_{c}": t[f"__c_{c}"] for c in carry})

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 16, carry: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """Removes each byte covered by a ``length``-byte string that also starts in a document of a smaller id.

    Returns id_col, n_bytes, spans (removed, in bytes), kept (binary), and the
    columns in ``carry``; one row for each input row.  ``characters`` spares bytes
    of a character that would be removed in part, so kept is valid UTF-8.

    Nulls: a null text is empty; a null id counts as larger than every id.  Rows
    of the same id do not remove each other's bytes.  Texts shorter than
    ``length`` stay whole.  An empty table gives none.  A text of any length is one
    document of its chunk, taken whole; texts of one chunk that come to 2 GiB together,
    as only one that is about as long can, are beyond Arrow's text column.  Columns that
    are not named are not read, whatever their names.
    """
    if not 8 < gram <= 16 <= length <= 1024:
        raise ValueError("gram must be 9 to 16 and length 16 to 1024")
    from pyspark.sql import functions as F

    texts, _, n_buckets = core.chunks_of(docs, id_col, text_col, carry)
    by_chunk = texts.groupBy("chunk")
    anchors = by_chunk.applyInArrow(_anchors(length, gram, n_buckets), core.ANCHORS)
    replies = anchors.groupBy("bucket").applyInArrow(core.repeated, core.REPEATS)
    runs = by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(_runs(length, gram, n_buckets), "part int, chunk int, blob binary")
    merged = runs.groupBy("part").applyInArrow(_merge(length), "chunk int, blob binary")
    schema = core.with_carried("id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary", texts, carry)
    out = by_chunk.cogroup(merged.groupBy("chunk")).applyInArrow(_apply(length, carry, characters), schema)
    return out.select(F.nullif(F.col("id"), F.lit(core.NULL_ID)).alias(id_col), "n_bytes", "spans", "kept", *[F.col(f"__c_{c}").alias(c) for c in carry])


def op8(spark, sf_dir):
    from pyspark.sql import functions as F

    out = suffix_dedup(core.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
