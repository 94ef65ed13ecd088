"""Files: raw objects, chunk artifacts, versioned snapshots and their pointer."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import raw_key, reader_route
from ..functions.text import decode_utf8, normalize_whitespace
from ..operators import snapshot

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def upload_plan(files: DataFrame) -> DataFrame:
    """name, key, size of uploads (filename, content); a blank name is an error."""
    name = F.regexp_extract(F.regexp_replace(F.coalesce("filename", F.lit("")), "/+$", ""), "([^/]*)$", 1)
    checked = F.when(name == "", F.raise_error(F.lit("Upload file must have a filename"))).otherwise(name)
    return files.select(checked.alias("name"), raw_key(name, F.expr("uuid()")).alias("key"), F.octet_length("content").cast("long").alias("size"))


def raw_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects below a folder: path, modificationTime, length, content (read only where it is used)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def listing(objects: DataFrame) -> DataFrame:
    """docId, fileName, uploadedAt of objects (key, original_filename, last_modified)."""
    return objects.select(F.col("key").alias("docId"), F.col("original_filename").alias("fileName"), F.date_format("last_modified", "yyyy-MM-dd").alias("uploadedAt"))


def docx_text(content: bytes) -> str:
    """Paragraphs of a document's body, a line each; tables are left out."""
    body = ElementTree.fromstring(zipfile.ZipFile(BytesIO(content)).read("word/document.xml")).find(f"{_WORD}body")
    marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    return "\n".join("".join(x.text or "" if x.tag == f"{_WORD}t" else marks.get(x.tag, "") for x in p.iter()) for p in (body.findall(f"{_WORD}p") if body is not None else []))


def extract_text(objects: DataFrame, pdf: Callable[[bytes], list[str | None]] | None = None) -> DataFrame:
    """doc_id, text, error of objects (doc_id, content) by their suffix.

    Text files are decoded in Spark; only .docx and .pdf go to Python.  ``pdf`` gives
    a file's pages, of which a null one is empty.
    """

    @F.pandas_udf("text string, error string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for routes, contents in batches:
            out = []
            for route, content in zip(routes, contents):
                try:
                    if route == "docx":
                        out.append((docx_text(content), None))
                    elif pdf is None:
                        out.append((None, "no PDF reader is plugged in"))
                    else:
                        out.append(("\n".join(p or "" for p in pdf(content)), None))
                except Exception as e:  # one bad file does not stop the others
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["text", "error"])

    routed = objects.withColumn("route", reader_route(F.col("doc_id")))
    plain = routed.filter("route = 'text'").select("doc_id", decode_utf8(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    other = routed.filter("route = 'unsupported'").select("doc_id", F.lit(None).cast("string").alias("text"), F.lit("Unsupported file type").alias("error"))
    packed = routed.filter("route IN ('docx', 'pdf')").select("doc_id", read("route", "content").alias("r")).select("doc_id", "r.text", "r.error")
    return plain.unionByName(packed).unionByName(other).withColumn("text", F.when(F.col("text").isNotNull(), normalize_whitespace(F.col("text"))))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, one folder for each document's bucket."""
    chunks.select("doc_id", "chunk_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("bucket")).write.mode("append").partitionBy("bucket").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id string, chunk_id string, text string, bucket int").json(path).drop("bucket")


def publish_snapshot(chunks: DataFrame, root: str, version: int, coalesced_events: int = 0) -> str:
    """Writes snapshot ``version`` to a folder of its own, then its pointer with the snapshot's statistics; readers follow the newest pointer.

    Folders are named anew each time and never overwritten, so a reader of the one before is not
    disturbed, and a publication that is run again leaves one that no pointer names.  Rows without a
    document, a chunk id or a text are an error, found before the pointer is written.
    """
    spark = chunks.sparkSession
    key = f"{root}/v{version}-{uuid.uuid4().hex[:12]}"
    chunks.write.parquet(key)
    written = spark.read.schema(chunks.schema).parquet(key)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = written.agg(F.count(F.when(blank("doc_id") | blank("chunk_id") | F.col("text").isNull(), 1))).first()[0]
    if bad:
        raise ValueError(f"{bad} malformed chunks in snapshot {version}")
    row = snapshot.stats(written, coalesced_events, version, version)
    row.select("corpus_version", F.lit(key).alias("key"), F.current_timestamp().alias("updated_at"), "doc_count", "chunk_count", "coalesced_event_count").coalesce(1).write.mode("append").json(f"{root}/pointers")
    return key


def read_snapshot(spark: SparkSession, root: str) -> tuple[DataFrame | None, int]:
    """The newest snapshot and its version; (None, 0) if none is published."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema("corpus_version long, key string").json(f"{root}/pointers").orderBy(F.desc("corpus_version")).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        row = None
    return (spark.read.parquet(row["key"]), row["corpus_version"]) if row else (None, 0)


def snapshot_statistics(spark: SparkSession, root: str) -> DataFrame:
    """corpus_version, key, updated_at, doc_count, chunk_count, coalesced_event_count of every published snapshot."""
    return spark.read.schema("corpus_version long, key string, updated_at timestamp, doc_count long, chunk_count long, coalesced_event_count long").json(f"{root}/pointers")
