"""Column functions over object keys and the ids made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

RAW_PREFIX = "raws"
CHUNK_PREFIX = "chunks"
# The file types that can be read.
READERS = {".pdf": "pdf", ".docx": "docx", ".txt": "text", ".md": "text"}


def decode_key(raw: Column) -> Column:
    """A key from its form encoding; what is not valid is kept but for plus signs."""
    return F.coalesce(F.try_url_decode(raw), F.replace(raw, F.lit("+"), F.lit(" ")))


def base_name(key: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(key, "/+$", ""), "([^/]*)$", 1)


def doc_name(key: Column, prefix: str = RAW_PREFIX) -> Column:
    """The name of a raw key without its prefix, folders and last extension."""
    bare = F.regexp_replace(F.regexp_replace(strip(key), "^/+", ""), f"^{prefix}/", "")
    return F.regexp_replace(base_name(bare), r"\.[^.]*$", "")


def stem(key: Column) -> Column:
    """The last part of a path without its suffix; a leading or trailing dot makes none."""
    name = base_name(key)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def suffix(key: Column) -> Column:
    """The lower-case suffix with its dot, or an empty string."""
    name = base_name(key)
    return F.lower(F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise(F.lit("")))


def chunk_file_key(doc_id: Column, prefix: str = CHUNK_PREFIX) -> Column:
    return F.concat(F.lit(f"{prefix}/"), stem(doc_id), F.lit("_chunks.jsonl"))


def chunk_id(doc_id: Column, ordinal: Column) -> Column:
    """Ordinals count from 1 and are padded to four digits, never cut."""
    return F.format_string("%s_chunk_%04d", doc_name(doc_id), ordinal)


def reader_route(doc_id: Column) -> Column:
    """Which reader takes a key: pdf, docx, text or unsupported."""
    out = F.lit("unsupported")
    for s, r in READERS.items():
        out = F.when(suffix(doc_id) == s, F.lit(r)).otherwise(out)
    return out


def raw_key(filename: Column, unique: Column, prefix: str = RAW_PREFIX) -> Column:
    """A key for an upload that cannot collide."""
    name = base_name(filename)
    tail = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise(F.lit(""))
    return F.concat(F.lit(f"{prefix}/"), stem(name), F.lit("-"), unique, tail)


def path_segment(value: str) -> str:
    """A configured folder without blanks and slashes at its ends; empty ones are refused."""
    out = value.strip().strip("/")
    if not out:
        raise ValueError("path segment is empty")
    return out
