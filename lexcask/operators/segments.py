"""A kept lexical index of immutable segments that takes deltas.

A segment numbers its chunks once and holds, in files of its own:

* ``docs``: number, document, ordinal, length and words of each chunk;
* ``blocks``: for each term and run of ``BLOCK`` chunk numbers the chunks that hold it, how
  often, and their lengths, with the greatest frequency and the least length, which
  bound what any of them can score;
* ``terms``: in how many chunks a term stands.

A delta adds one segment of the changed documents' new chunks and a list of the chunks
that are gone, with their terms taken off the counts; segments of other documents are
not written.  ``df`` and the totals are sums over segments, made at read.  A commit file
names the segments; it is created only if absent and readers follow the newest one.
``merge`` writes all that is alive as one segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches
from ..functions.text import ws_tokens
from ..sources import commits

#: Chunk numbers of one block.
BLOCK = 256
#: Folders that terms are dealt to by their hash: a search reads its terms' folders alone.
SLOTS = 64

DOCS = "n bigint, doc_id string, chunk_ord int, dl bigint, words array<string>"
BLOCKS = "term string, block bigint, ns array<bigint>, tfs array<int>, dls array<bigint>, max_tf int, min_dl bigint"
GONE = "seg int, n bigint, doc_id string, dl bigint, words array<string>"


def slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def _parts(n: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of chunks that end where a block ends; one that is too large by itself is cut."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(n // BLOCK) != 0])) if len(n) else np.zeros(0, np.int64)
    ends = np.append(first, len(n))
    for a, b in batches.parts(np.add.reduceat(size, first) if len(n) else size):
        for c, d in batches.parts(size[ends[a] : ends[b]], 2 * batches.WORDS):
            yield int(ends[a]) + c, int(ends[a]) + d


def _blocks(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the chunks (n, dl, words) of each batch, some at a time; one that two parts share is written in two rows."""
    for b in arrived:
        sizes = b.column("words").value_lengths().to_numpy(zero_copy_only=False)
        for start, end in _parts(b.column("n").to_numpy(), sizes):
            words = b.column("words").slice(start, end - start)
            n, dl, size = b.column("n").to_numpy()[start:end], b.column("dl").to_numpy()[start:end], sizes[start:end]
            flat = words.flatten().dictionary_encode()
            if not len(flat):
                continue
            chunk = np.repeat(np.arange(len(n)), size)
            key, tf = np.unique(flat.indices.to_numpy().astype(np.int64) * len(n) + chunk, return_counts=True)
            term, chunk = key // len(n), key % len(n)
            block = n[chunk] // BLOCK
            order = np.lexsort((n[chunk], block, term))
            term, chunk, block, tf = term[order], chunk[order], block[order], tf[order].astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
            offsets = pa.array(np.append(first, len(term)).astype(np.int32))
            lists = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x))  # noqa: B023, E731
            columns = [flat.dictionary.take(pa.array(term[first])), pa.array(block[first]), lists(n[chunk]), lists(tf), lists(dl[chunk]), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(dl[chunk], first))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in BLOCKS.split(", ")])


@dataclass(frozen=True)
class State:
    """The segments (number: folder), the lists of chunks that are gone, the number of chunks alive and their words, the mean idf of all terms."""

    number: int = 0
    segments: dict[str, str] = field(default_factory=dict)
    gone: list[str] = field(default_factory=list)
    n_chunks: int = 0
    n_words: int = 0
    mean_idf: float | None = None


def raw_idf(df: Column, n_chunks: Column | int) -> Column:
    n = n_chunks if isinstance(n_chunks, Column) else F.lit(n_chunks)
    return F.log(n - df + 0.5) - F.log(df + 0.5)


class Index:
    """The segments below a folder, as of one commit."""

    def __init__(self, spark: SparkSession, root: str, state: State | None = None):
        self.spark, self.root = spark, root
        self.state = state if state is not None else State(**(commits.newest(spark, f"{root}/commits") or {}))

    def _all(self, what: str, schema: str) -> DataFrame:
        frames = [self.spark.read.schema(schema).parquet(f"{f}/{what}").withColumn("seg", F.lit(int(s))) for s, f in self.state.segments.items()]
        out = frames[0] if frames else self.spark.createDataFrame([], f"{schema}, seg int")
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    def gone(self) -> DataFrame:
        """The chunks that no longer count."""
        return self.spark.read.schema(GONE).parquet(*self.state.gone) if self.state.gone else self.spark.createDataFrame([], GONE)

    def alive(self, rows: DataFrame) -> DataFrame:
        """Rows with (seg, n) of chunks that count."""
        return rows.join(self.gone().select("seg", "n"), ["seg", "n"], "left_anti") if self.state.gone else rows

    def docs(self) -> DataFrame:
        """seg, n, doc_id, chunk_ord, dl, words of every chunk."""
        return self.alive(self._all("docs", DOCS))

    def blocks(self, slots: list[int] | None = None) -> DataFrame:
        """The blocks of all terms, or of some folders, with their segment; chunks that are gone are in them still."""
        rows = self._all("blocks", f"{BLOCKS}, slot int")
        return (rows if slots is None else rows.filter(F.col("slot").isin(slots))).drop("slot")

    def df(self, terms: DataFrame | None = None) -> DataFrame:
        """term, df over all segments, less the chunks that are gone; of all terms or those given (broadcast by the caller if few)."""
        counts = self._all("terms", "term string, df bigint").select("term", "df")
        if self.state.gone:
            counts = counts.unionByName(self.gone().select(F.explode(F.array_distinct("words")).alias("term"), F.lit(-1).cast("long").alias("df")))
        if terms is not None:
            counts = counts.join(terms, "term", "left_semi")
        return counts.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def _write(self, chunks: DataFrame, segment: int) -> tuple[str, int, int]:
        """A segment's folder, chunks and words."""
        folder = f"{self.root}/segment-{segment}-{commits.unique()}"
        words = chunks.select(F.monotonically_increasing_id().alias("n"), "doc_id", F.col("chunk_ord").cast("int").alias("chunk_ord"), ws_tokens(F.col("text")).alias("words"))
        words.select("n", "doc_id", "chunk_ord", F.size("words").cast("long").alias("dl"), "words").write.parquet(f"{folder}/docs")
        docs = self.spark.read.schema(DOCS).parquet(f"{folder}/docs")
        # The exchange splits a folder of frequent terms into several files.
        dealt = docs.select("n", "dl", "words").mapInArrow(_blocks, BLOCKS).withColumn("slot", slot(F.col("term"))).hint("rebalance", "slot")
        dealt.sortWithinPartitions("slot", "term", "block").write.partitionBy("slot").parquet(f"{folder}/blocks")
        self.spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").groupBy("term").agg(F.sum(F.size("ns")).cast("long").alias("df")).write.parquet(f"{folder}/terms")
        n, words = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return folder, n, words

    def _commit(self, **changes) -> Index:
        state = State(**{**asdict(self.state), **changes, "number": self.state.number + 1})
        state = replace(state, mean_idf=Index(self.spark, self.root, state).df().agg(F.avg(raw_idf(F.col("df"), state.n_chunks))).first()[0])
        if not commits.create(self.spark, f"{self.root}/commits", state.number, asdict(state)):
            raise RuntimeError("another writer has changed the index")
        return Index(self.spark, self.root, state)

    def add(self, chunks: DataFrame, changed: DataFrame | None = None) -> Index:
        """The index after a delta: documents of ``changed`` (doc_id) lose their chunks, those given (doc_id, chunk_ord, text) come in.

        Written are one segment of the new chunks and the chunks that are gone.
        """
        segment = 1 + max(map(int, self.state.segments), default=-1)
        folder, n, words = self._write(chunks, segment)
        gone, out_n, out_words = self.state.gone, 0, 0
        if changed is not None and self.state.segments:
            path = f"{self.root}/gone-{segment}-{commits.unique()}"
            self.docs().join(changed.select("doc_id").distinct(), "doc_id", "left_semi").select("seg", "n", "doc_id", "dl", "words").write.parquet(path)
            out_n, out_words = self.spark.read.schema(GONE).parquet(path).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            gone = [*gone, path] if out_n else gone
        segments = self.state.segments | ({str(segment): folder} if n else {})
        return self._commit(segments=segments, gone=gone, n_chunks=self.state.n_chunks + n - out_n, n_words=self.state.n_words + words - out_words)

    def merge(self) -> Index:
        """The same index as one segment, without what is gone; readers of earlier commits are not disturbed."""
        segment = 1 + max(map(int, self.state.segments), default=-1)
        folder, n, words = self._write(self.docs().select("doc_id", "chunk_ord", F.array_join("words", " ").alias("text")), segment)
        return self._commit(segments={str(segment): folder} if n else {}, gone=[], n_chunks=n, n_words=words)


def build(chunks: DataFrame, root: str) -> Index:
    """A new index of chunks (doc_id, chunk_ord, text)."""
    return Index(chunks.sparkSession, root, State()).add(chunks)


def refresh(index: Index, net: DataFrame, artifacts: DataFrame) -> Index:
    """The index after net changes (doc_id, op): changed documents' chunks go, upserted ones' come from the artifacts."""
    fresh = artifacts.join(net.filter("op = 'upsert'").select("doc_id"), "doc_id", "left_semi")
    return index.add(fresh.select("doc_id", "chunk_ord", "text"), net)
