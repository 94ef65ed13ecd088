"""Harmonic packing of documents' tokens into sequences.

Lengths fall into reciprocal-capacity classes: class ``k`` (1, 2, 4, ...) takes
pieces of at most ``capacity / k`` tokens and every bin of it holds exactly ``k``
of them.  A document is cut so that its pieces nearly fill their classes: whole
sequences first, then the largest class below what is left, and so on; what is
within ``slack`` of a class, or below the smallest, goes there uncut.  Each
worker fills its own bins by count alone, with nothing exchanged; at the end of
its partition the unfilled bins' pieces, largest first, share sequences, of which
all but the last are full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import core, tokens

CAPACITY = 1024
#: Classes go down to pieces of so many tokens.
SMALLEST = 16
#: A piece may be short of its class by this share.
SLACK = 1 / 64


def cut(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST, slack: float = SLACK) -> list[tuple[int, int, int]]:
    """(start, length, size of its class) of each piece of ``n`` tokens."""
    out, at = [], 0
    while n - at >= capacity:
        out.append((at, capacity, capacity))
        at += capacity
    size = capacity
    while at < n:
        rest = n - at
        while size > smallest and size // 2 >= rest:
            size //= 2
        if rest >= size * (1 - slack) or size <= smallest:
            out.append((at, rest, size))
            break
        size //= 2
        out.append((at, size, size))
        at += size
    return out


class Bins:
    """One worker's open bins; sequences get numbers of its own."""

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity = first, capacity
        self.open: dict[int, list] = {}

    def add(self, piece: tuple, size: int) -> list[tuple]:
        """Rows of the sequence that this piece fills, if it fills one."""
        if size == self.capacity:
            return self.close([piece])
        held = self.open.setdefault(size, [])
        held.append(piece)
        if len(held) * size == self.capacity:
            del self.open[size]
            return self.close(held)
        return []

    def close(self, pieces: list[tuple]) -> list[tuple]:
        number, at, out = self.next, 0, []
        self.next += 1
        for p in pieces:
            out.append((*p, number, at))
            at += p[2]
        return out

    def rest(self) -> list[tuple]:
        out, held, room = [], [], self.capacity
        for size in sorted(self.open, reverse=True):
            for p in self.open[size]:
                if size > room:
                    out += self.close(held)
                    held, room = [], self.capacity
                held.append(p)
                room -= size
        self.open = {}
        return out + (self.close(held) if held else [])


SCHEMA = "id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack(path: str, eos: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, end = tokens.coder(path), eos.to_bytes(4, "little")
        bins = Bins(TaskContext.get().partitionId() << 33, capacity)

        def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [kind, *[pa.int64()] * 4, pa.binary(), pa.int64(), pa.int64()]
            c = [pa.array(x, k) for x, k in zip(cols, kinds)]
            return pa.RecordBatch.from_arrays([*c[:5], c[6], c[7], c[5]], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("id").type
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for doc, ids in zip(part.column("id").to_pylist(), coder.encode(part.column("text").to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    for start, length, size in cut(n, capacity):
                        own = ids[4 * start : 4 * (start + length)]
                        rows += bins.add((doc, start, length, zlib.crc32(own), n, own if with_ids else None), size)
                yield table(rows, kind)
        yield table(bins.rest(), kind)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, eos: int = 0, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Packs every document's token ids, then ``eos``, into sequences of at most ``capacity``.

    One row for each piece: id_col, start and length in its document's ids,
    ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit,
    null without ``with_ids``).  A sequence's pieces lie one after the other from
    offset 0.  ``capacity`` is a power of two, at least 16.

    Nulls: a null text is empty, so its document is the one id ``eos``; a null id
    stays null.  Repeated rows are packed as often as they occur.  An empty table
    gives none; a text of any length is encoded and cut whole.  Other columns are not
    read, whatever their names.
    """
    if capacity < SMALLEST or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two, at least 16")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = rows.mapInArrow(_pack(tokenizer or tokens.byte_bpe_path(), eos, capacity, with_ids), SCHEMA.format(dict(rows.dtypes)["id"]))
    return out.withColumnRenamed("id", id_col)


def op3(spark, sf_dir):
    return pack(core.table(spark, sf_dir, "documents"), with_ids=False).drop("ids")
