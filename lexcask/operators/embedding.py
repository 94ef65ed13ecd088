"""Embedding of chunks, with a plug-in for dense models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions import batches
from ..functions.text import word_tokens

DIMENSIONS = 64


def _counted(buckets: pa.Array, dimensions: int) -> pa.Array:
    """Counts of many texts at once: an array function would pass over the words once for each bucket."""
    size = buckets.value_lengths().to_numpy(zero_copy_only=False)
    n = np.zeros(len(size) * dimensions, np.float32)
    for a, b in batches.parts(size):
        place = np.repeat(np.arange(b - a), size[a:b]) * dimensions + buckets.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
        n[a * dimensions : b * dimensions] = np.bincount(place.astype(np.int64), minlength=(b - a) * dimensions)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * dimensions), pa.array(n))


def hashed_counts(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The default: how many words fall into each of so many hash buckets (whole numbers; 256 buckets at most)."""
    at = F.transform(word_tokens(text), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int"), F.lit(dimensions)))

    return F.arrow_udf(lambda buckets: _counted(buckets, dimensions), ArrayType(FloatType()))(at)


def embed_chunks(chunks: DataFrame, embed: Callable[[Column], Column] = hashed_counts) -> DataFrame:
    """key, doc_id, embedding of each chunk (doc_id, chunk_id, text); the key is the chunk_id."""
    return chunks.select(F.col("chunk_id").alias("key"), "doc_id", embed(F.col("text")).alias("embedding"))


def vector_records(embedded: DataFrame) -> DataFrame:
    """key, data, metadata, as the vector service takes them."""
    return embedded.select("key", F.struct(F.col("embedding").alias("float32")).alias("data"), F.create_map(F.lit("doc_id"), F.col("doc_id")).alias("metadata"))


def dense_embedder(model: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """An embedder from a function on batches of texts, run in Arrow batches."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()))

    return embed
