"""The corpus of chunks: bootstrap, upserts and deletes, merges, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import chunk_file_key
from .changelog import net_changes


def indexed_doc_ids(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("status") == "indexed").select("doc_id")


def bootstrap(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the documents that the manifest calls indexed."""
    return chunks.join(indexed_doc_ids(manifest), "doc_id", "left_semi")


def remove_docs(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Chunks without those documents'; unknown ids change nothing."""
    return chunks.join(doc_ids.select("doc_id"), "doc_id", "left_anti")


def apply_changes(base: DataFrame, changes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The base after net changes: a changed document's rows go, and an upserted one's come from the artifacts.

    An upsert without artifacts is a plain delete.
    """
    net = net_changes(changes)
    fresh = artifacts.join(net.filter("op = 'upsert'"), "doc_id", "left_semi")
    return remove_docs(base, net).unionByName(fresh.select(*base.columns))


def merge_chunks(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both, the second's row where a chunk_id is in each."""
    both = first.withColumn("__k", F.lit(0)).unionByName(second.withColumn("__k", F.lit(1)))
    last = F.max_by(F.struct("doc_id", "text"), F.struct("__k", "doc_id", "text"))
    return both.groupBy("chunk_id").agg(last.alias("r")).select("chunk_id", "r.doc_id", "r.text")


def doc_chunk_index(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_ids (sorted, distinct)."""
    return chunks.groupBy("doc_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))


def chunk_to_doc(index: DataFrame) -> DataFrame:
    """chunk_id, doc_id from a document index; the greatest document where several hold a chunk."""
    return index.select("doc_id", F.explode("chunk_ids").alias("chunk_id")).groupBy("chunk_id").agg(F.max("doc_id").alias("doc_id"))


def chunks_to_jsonl(chunks: DataFrame) -> DataFrame:
    """file_key, line: the lines of each document's artifact."""
    return chunks.select(chunk_file_key(F.col("doc_id")).alias("file_key"), F.to_json(F.struct("doc_id", "chunk_id", "text")).alias("line"))


def load_lines(lines: DataFrame) -> DataFrame:
    """Chunks from JSON lines (doc_id, line_no, line): blank lines skipped, the last of a chunk_id wins."""
    row = F.from_json("line", "doc_id string, chunk_id string, text string")
    rows = lines.filter(F.trim("line") != "").select(F.col("line_no"), row.alias("r"))
    last = F.max_by(F.struct("r.doc_id", "r.text"), F.col("line_no"))
    return rows.groupBy(F.col("r.chunk_id").alias("chunk_id")).agg(last.alias("c")).select("chunk_id", "c.doc_id", "c.text")


def chunk_payload(chunks: DataFrame) -> DataFrame:
    """id, text and metadata as the vector service takes them."""
    return chunks.select(F.col("chunk_id").alias("id"), "text", F.col("doc_id").alias("metadata_doc_id"))


def number_chunks(chunks: DataFrame, by: str) -> DataFrame:
    """Adds ordinal, from 1 in each document."""
    return chunks.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy(by)))
