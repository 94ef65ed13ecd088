"""Exact removal of repeated word passages over a De Bruijn graph of the corpus.

An edge of the graph is a window of 20 words (a k-mer), its nodes are the 19
words at either side.  A first exchange of packed anchor hashes (the least
10-word gram of a window) leaves only the edges that can be repeated.  A second
one sends each chunk's distinct edges, as two 64-bit fingerprints and the place
of the first occurrence, to a bucket by the first fingerprint; there the second
verifies them, and every later occurrence learns its source coordinates.  Joined
to its chunk's text again, consecutive edges whose sources advance in step lie
on one nonbranching path and compact into a single span: where the graph
branches, the source jumps.  A span of n edges is a repeat of n + 19 words.

Edges go to buckets by their own hash and once for each chunk, so neither a
passage that a third of all documents holds nor a group of copies makes a
bucket large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .suffix_dedup import _unzip, _zip, ordered


class _Words:
    """A chunk's words: hashes, each row's first word, and which windows lie within a row."""

    def __init__(self, t: pa.Table, length: int, gram: int):
        self.t = ordered(t) if len(t) else t
        self.raw, off = core.joined(self.t["text"])
        self.ids = self.t["id"].to_numpy()
        self.start, self.end, self.row = core.words_of(self.raw, off)
        self.off = np.searchsorted(self.row, np.arange(len(self.ids) + 1))
        self.hash = core.word_hashes(self.raw, self.start, self.end)
        self.n = max(0, len(self.start) - length + 1)
        self.valid = self.row[: self.n] == self.row[len(self.row) - self.n :] if self.n else np.zeros(0, bool)
        self.length, self.gram = length, gram

    def anchors(self) -> np.ndarray:
        """For each window, the least gram in it."""
        if not self.n:
            return np.zeros(0, np.uint64)
        return core.slide(np.minimum, core.grams(self.hash, self.gram), self.length - self.gram + 1)

    def edges(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return core.grams(self.hash, self.length)[at], core.grams(self.hash, self.length, 1)[at]

    def first_of_run(self, least: np.ndarray) -> np.ndarray:
        edge = np.empty(self.n, bool)
        if self.n:
            edge[0] = True
            edge[1:] = (least[1:] != least[:-1]) | ~self.valid[:-1]
        return edge & self.valid


def _anchors(length: int, gram: int, n_buckets: int):
    def run(t: pa.Table) -> pa.Table:
        w = _Words(t, length, gram)
        least = w.anchors()
        return core.anchor_rows(t["chunk"][0].as_py(), core.spread(least[w.first_of_run(least)]), n_buckets)

    return run


def _edges(length: int, gram: int, n_buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"part": [], "chunk": [], "blob": [], "n": []}
        if len(left) and len(right):
            w = _Words(left, length, gram)
            least = w.anchors()
            first = w.first_of_run(least)
            rep, _ = core.repeat_flags(core.spread(least[first]), n_buckets, right)
            run_of = np.cumsum(first) - 1
            at = np.flatnonzero(w.valid)
            at = at[rep[run_of[at]]]
            if len(at):
                h, check = w.edges(at)
                order = np.lexsort((check, h))  # stable: the first of equal ones stands first in the chunk
                h, check, at = h[order], check[order], at[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
                h, check, at = h[new], check[new], at[new]
                ids, place = w.ids[w.row[at]], at - w.off[w.row[at]]
                for p, lo, hi in core.filled(h, n_buckets):
                    s = slice(lo, hi)
                    out["part"].append(p)
                    out["n"].append(hi - lo)
                    out["chunk"].append(left["chunk"][0].as_py())
                    out["blob"].append(h[s].astype("<u8").tobytes() + check[s].astype("<u8").tobytes() + _zip(ids[s].astype("<i8").tobytes() + place[s].astype("<u4").tobytes()))
        return pa.table({"part": pa.array(out["part"], pa.int32()), "chunk": pa.array(out["chunk"], pa.int32()), "blob": pa.array(out["blob"], pa.binary()), "n": pa.array(out["n"], pa.int32())})

    return run


def _sources(t: pa.Table) -> pa.Table:
    chunks, ns = t["chunk"].to_pylist(), t["n"].to_pylist()
    parts = []
    for b, n in zip(t["blob"].to_pylist(), ns):
        z = _unzip(b[16 * n :])
        parts.append((np.frombuffer(b, "<u8", n), np.frombuffer(b, "<u8", n, 8 * n), np.frombuffer(z, "<i8", n), np.frombuffer(z, "<u4", n, 8 * n)))
    h, check, ids, place = (np.concatenate([p[k] for p in parts]) for k in range(4))
    who = np.repeat(np.arange(len(ns)), ns)
    order = np.lexsort((place, ids, check, h))
    h, check, ids, place, who = (x[order] for x in (h, check, ids, place, who))
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    late = np.flatnonzero(~new & (ids[first] < ids))
    late = late[np.argsort(who[late], kind="stable")]
    cut = np.searchsorted(who[late], np.arange(len(ns) + 1))
    out_chunk, out_blob, out_n = [], [], []
    for c, lo, hi in zip(chunks, cut[:-1].tolist(), cut[1:].tolist()):
        if hi > lo:
            s, f = late[lo:hi], first[late[lo:hi]]
            out_chunk.append(c)
            out_n.append(hi - lo)
            out_blob.append(h[s].tobytes() + check[s].tobytes() + _zip(ids[f].tobytes() + place[f].tobytes()))
    return pa.table({"chunk": pa.array(out_chunk, pa.int32()), "blob": pa.array(out_blob, pa.binary()), "n": pa.array(out_n, pa.int32())})


def _compact(length: int, gram: int, carry: tuple[str, ...]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        w = _Words(left, length, gram)
        n_words = len(w.start)
        src_id = np.full(w.n, -1, np.int64)
        src_at = np.full(w.n, -1, np.int64)
        found = np.zeros(w.n, bool)
        at = np.flatnonzero(w.valid)
        if len(at):
            h, check = w.edges(at)
            order = np.lexsort((check, h))  # stable: equal ones stand in the order of rows, then of words
            hs, cs, rows, spots = h[order], check[order], w.row[at][order], at[order]
            # Within a row: the first window of the same words.
            other = np.concatenate([[True], (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])])
            new = other | np.concatenate([[True], rows[1:] != rows[:-1]])
            first = spots[np.flatnonzero(new)[np.cumsum(new) - 1]]
            own = ~new
            found[spots[own]] = True
            src_id[spots[own]] = w.ids[rows[own]]
            src_at[spots[own]] = first[own] - w.off[rows[own]]
            # In another row of this chunk, of a smaller id.
            lead = np.flatnonzero(other)[np.cumsum(other) - 1]
            near = w.ids[rows[lead]] < w.ids[rows]
            found[spots[near]] = True
            src_id[spots[near]] = w.ids[rows[lead[near]]]
            src_at[spots[near]] = spots[lead[near]] - w.off[rows[lead[near]]]
            # In another chunk, in a document of a still smaller id: what the buckets say.
            for b, n in zip(right["blob"].to_pylist(), right["n"].to_pylist()):
                rh, rc = np.frombuffer(b, "<u8", n), np.frombuffer(b, "<u8", n, 8 * n)
                z = _unzip(b[16 * n :])
                ri, rp = np.frombuffer(z, "<i8", n), np.frombuffer(z, "<u4", n, 8 * n)
                by = np.lexsort((rc, rh))
                lo, hi = np.searchsorted(hs, rh[by], "left"), np.searchsorted(hs, rh[by], "right")
                k = np.repeat(np.arange(n), hi - lo)
                j = np.arange(len(k)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[k]
                hit = (cs[j] == rc[by][k]) & (w.ids[rows[j]] > ri[by][k])
                j, k = j[hit], by[k[hit]]
                found[spots[j]] = True
                src_id[spots[j]] = ri[k]
                src_at[spots[j]] = rp[k]
        # Consecutive windows whose sources advance in step are one path.
        step = src_at - np.arange(w.n)
        head = found.copy()
        if w.n:
            head[1:] &= ~(found[:-1] & (src_id[1:] == src_id[:-1]) & (step[1:] == step[:-1]) & (w.row[1 : w.n] == w.row[: w.n - 1]))
        heads = np.flatnonzero(head)
        size = np.add.reduceat(found, heads, dtype=np.int64) if len(heads) else np.zeros(0, np.int64)
        cover = np.zeros(n_words + 1, np.int32)
        np.add.at(cover, heads, 1)
        np.add.at(cover, heads + size + length - 1, -1)
        gone = np.cumsum(cover[:-1]) > 0
        # The words that stay, one space between them.
        lens = (w.end - w.start)[~gone]
        inside = np.zeros(len(w.raw) + 1, np.int32)
        np.add.at(inside, w.start[~gone], 1)
        np.add.at(inside, w.end[~gone], -1)
        text = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
        text[np.arange(int(lens.sum())) + np.repeat(np.arange(len(lens)), lens)] = w.raw[np.cumsum(inside[:-1]) > 0]
        buf = text.tobytes()
        left_before = np.concatenate([[0], np.cumsum(~gone)])[w.off]
        at_byte = np.concatenate([[0], np.cumsum(lens + 1)])[left_before]
        kept = [buf[a : max(a, z - 1)] for a, z in zip(at_byte[:-1].tolist(), at_byte[1:].tolist())]
        per = np.bincount(w.row[heads], minlength=len(w.ids)) if len(heads) else np.zeros(len(w.ids), np.int64)
        bounds = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
        sid = pa.array(src_id[heads], pa.int64(), mask=src_id[heads] == core.NULL_ID)
        struct = pa.StructArray.from_arrays([pa.array(heads - w.off[w.row[heads]] if len(heads) else heads, pa.int64()), pa.array(size + length - 1, pa.int64()), sid, pa.array(src_at[heads], pa.int64())], ["start", "n_words", "source_id", "source_start"])
        words = np.diff(w.off)
        out = {
            "id": w.t["id"].cast(pa.int64()),
            "n_words": pa.array(words, pa.int64()),
            "n_removed": pa.array(words - np.diff(left_before), pa.int64()),
            "paths": pa.ListArray.from_arrays(pa.array(bounds), struct),
            "kept": pa.array(kept, pa.binary()),
        }
        return pa.table(out | {f"__c_{c}": w.t[f"__c_{c}"] for c in carry})

    return run


def path_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, gram: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes each word covered by a window of ``length`` words that also starts earlier.

    Earlier is in a document of a smaller id, or before in the same row.  Returns
    id_col, n_words, n_removed, paths (start, n_words, source_id, source_start: the
    compacted repeats, in words), kept (binary: the words left, one space
    between), and the columns in ``carry``; one row for each input row.

    Nulls: a null text has no words; a null id counts as larger than every id.
    Two rows of one id do not remove each other's words.  Shorter texts stay
    whole.  An empty table gives none.  A text of any length is one document of its
    chunk, taken whole; texts of one chunk that come to 2 GiB together, as only one
    that is about as long can, are beyond Arrow's text column.  Columns that are not
    named are not read, whatever their names.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must be from 1 to length")
    texts, _, n_buckets = core.chunks_of(docs, id_col, text_col, carry)
    by_chunk = texts.groupBy("chunk")
    anchors = by_chunk.applyInArrow(_anchors(length, gram, n_buckets), core.ANCHORS)
    replies = anchors.groupBy("bucket").applyInArrow(core.repeated, core.REPEATS)
    edges = by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(_edges(length, gram, n_buckets), "part int, chunk int, blob binary, n int")
    sources = edges.groupBy("part").applyInArrow(_sources, "chunk int, blob binary, n int")
    schema = core.with_carried("id long, n_words long, n_removed long, paths array<struct<start: long, n_words: long, source_id: long, source_start: long>>, kept binary", texts, carry)
    out = by_chunk.cogroup(sources.groupBy("chunk")).applyInArrow(_compact(length, gram, carry), schema)
    return out.select(F.nullif(F.col("id"), F.lit(core.NULL_ID)).alias(id_col), "n_words", "n_removed", "paths", "kept", *[F.col(f"__c_{c}").alias(c) for c in carry])


def op2(spark, sf_dir):
    out = path_dedup(core.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
