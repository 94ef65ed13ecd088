"""Versioned snapshots of the corpus: build, load, publish, and the guards around a rebuild."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def stats(chunks: DataFrame, coalesced_events: int, target: int, cursor: int) -> DataFrame:
    """One row: corpus_version (the later of target and cursor), doc_count, chunk_count, coalesced_event_count."""
    return chunks.agg(F.countDistinct("doc_id").alias("doc_count"), F.count("*").alias("chunk_count")).select(
        F.lit(max(target, cursor)).cast("long").alias("corpus_version"), "doc_count", "chunk_count", F.lit(coalesced_events).cast("long").alias("coalesced_event_count")
    )


def documents(chunks: DataFrame) -> DataFrame:
    """id, page_content, metadata(doc_id, chunk_id); a missing document is an empty string."""
    return chunks.select(F.col("chunk_id").alias("id"), F.col("text").alias("page_content"), F.struct(F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.col("chunk_id").alias("chunk_id")).alias("metadata"))


def load(rows: DataFrame) -> DataFrame:
    """doc_id, chunk_id, page_content of a snapshot's rows (JSON strings in ``row``); malformed rows are skipped, ids trimmed.

    Of a repeated chunk_id the last row (by ``row_no``) gives the content.
    """
    v = F.try_parse_json("row")

    def text(path: str) -> Column:
        found = F.try_variant_get(F.col("v"), path, "variant")
        return F.when(F.coalesce(F.schema_of_variant(found).startswith("STRING"), F.lit(False)), F.try_variant_get(F.col("v"), path, "string"))

    parsed = rows.select("row_no", v.alias("v")).select("row_no", strip(text("$.id")).alias("chunk_id"), text("$.page_content").alias("page_content"), strip(text("$.metadata.doc_id")).alias("doc_id"))
    good = parsed.filter("chunk_id <> '' AND page_content IS NOT NULL AND doc_id <> ''")
    last = good.groupBy("chunk_id").agg(F.max_by("page_content", "row_no").alias("page_content"))
    return good.select("doc_id", "chunk_id").distinct().join(last, "chunk_id").select("doc_id", "chunk_id", "page_content")


def latest_pointer(pointers: DataFrame) -> DataFrame:
    """One row: corpus_version and key of the newest pointer; version 0 if there is none."""
    return pointers.agg(F.coalesce(F.max("corpus_version"), F.lit(0)).cast("long").alias("corpus_version"), F.max_by("key", "corpus_version").alias("key"))


def rebuild_needed(pointer_version: Column, target: Column) -> Column:
    """Whether a snapshot is behind its target."""
    return pointer_version < target


def rebuild_guard(pointer_version: Column, target: Column, n_changes: Column) -> Column:
    """skip, rebuild, or error: behind its target, yet without changes to apply."""
    return F.when(pointer_version >= target, F.lit("skip")).when(n_changes == 0, F.lit("error")).otherwise(F.lit("rebuild"))
