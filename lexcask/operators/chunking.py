"""Semantic chunking: sentences are parted where neighbours' meanings lie far apart.

Every sentence is taken with the one before and after it and embedded; between two
neighbours lies one distance.  Distances above the document's 90th percentile part
it.  The embedder counts words (by their 64-bit hashes), so that products are whole
numbers and every engine finds the same distances.  All of it lies within one
document, so there is no exchange.  Sentences and words are array functions; the
products are taken in Arrow batches, as folding each word through an array function
took eight times as long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import batches
from ..functions.keys import chunk_id
from ..functions.text import SPACE_CLASS, normalize_whitespace, word_tokens

PERCENTILE = 0.9
DIGITS = 9


def sentences(text: Column) -> Column:
    """The sentences of a text, white space normalised; an empty text has none."""
    return F.filter(F.split(normalize_whitespace(text), r"(?<=[.?!])\s+"), lambda x: x != "")


def _products(sentence: np.ndarray, word: np.ndarray, n: int) -> list[np.ndarray]:
    """For each sentence, the product of its word counts with its own and those of the next three."""
    _, word = np.unique(word, return_inverse=True)
    width = int(word.max()) + 1 if len(word) else 1
    key, count = np.unique(sentence * width + word, return_counts=True)
    out = []
    for ahead in range(4):
        at = np.minimum(np.searchsorted(key, key + ahead * width), len(key) - 1)
        both = np.where(key[at] == key + ahead * width, count * count[at], 0) if len(key) else key
        out.append(np.bincount(key // width, both, minlength=n + 4)[: n + 4])
    return out


def _distances(words: pa.Array) -> pa.Array:
    """Distances of a batch of documents, each a list of sentences, each a list of words' hashes; some documents at a time."""
    inner = words.flatten()
    ends = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    held = np.concatenate([[0], np.cumsum(inner.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    out = [_of_part(words.slice(a, b - a)) for a, b in batches.parts(np.diff(held[ends]))]
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))


def _of_part(words: pa.Array) -> pa.Array:
    per = words.value_lengths().to_numpy(zero_copy_only=False)
    first = np.cumsum(per) - per
    total = int(per.sum())
    # Sentences of different documents are numbered more than three apart.
    number = np.arange(total) + 4 * np.repeat(np.arange(1, len(per) + 1), per)
    inner = words.flatten()
    sizes = inner.value_lengths().to_numpy(zero_copy_only=False)
    s0, s1, s2, s3 = _products(np.repeat(number, sizes), inner.flatten().to_numpy(zero_copy_only=False), total + 4 * len(per) + 4)
    at = number[np.delete(np.arange(total), (first + per - 1)[per > 0])] if total else number
    # Each window is a sentence and its neighbours; those beyond either end have no words.
    a, b, c = at - 1, at, at + 1
    norm = lambda m: s0[m - 1] + s0[m] + s0[m + 1] + 2 * (s1[m - 1] + s1[m] + s2[m - 1])
    left, right = norm(b), norm(c)
    both = s1[a] + s2[a] + s3[a] + s0[b] + s1[b] + s2[b] + s1[b] + s0[c] + s1[c]
    fine = (left > 0) & (right > 0)
    cos = np.where(fine, both / np.where(fine, np.sqrt(left) * np.sqrt(right), 1), 0.0)
    ends = np.concatenate([[0], np.cumsum(np.maximum(per - 1, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(1 - cos, pa.float64()))


def with_distances(docs: DataFrame) -> DataFrame:
    """doc_id, sentences, distances: between each sentence, with its neighbours, and the next."""
    # A text has sentences if it has anything but white space; a filter on the sentences themselves would make them twice.
    split = docs.filter(F.col("text").rlike(f"[^{SPACE_CLASS[1:]}")).select("doc_id", sentences(F.col("text")).alias("sentences"))
    words = F.transform("sentences", lambda x: F.transform(word_tokens(x), lambda w: F.xxhash64(w)))
    return split.withColumn("distances", F.arrow_udf(_distances, ArrayType(DoubleType()))(words)).withColumn("distances", F.transform("distances", lambda d: F.round(d, DIGITS)))


def threshold(distances: Column, share: float = PERCENTILE) -> Column:
    """The exact percentile of an array, interpolated; null if it is empty."""

    def of(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(share)
        low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
        return F.round(F.get(s, low) + (F.get(s, high) - F.get(s, low)) * (place - low), DIGITS)

    return F.transform(F.array(F.sort_array(distances)), of)[0]


def with_breaks(docs: DataFrame) -> DataFrame:
    """with_distances and the threshold of each document."""
    return with_distances(docs).withColumn("threshold", threshold(F.col("distances")))


def distances(docs: DataFrame) -> DataFrame:
    """doc_id, i (from 0), distance: one less the cosine of sentence i and the next, as word counts; 1 where one has no words."""
    return with_distances(docs).select("doc_id", F.posexplode("distances").alias("i", "distance"))


def breakpoints(docs: DataFrame) -> DataFrame:
    """doc_id, i, distance, threshold, is_break (strictly above)."""
    rows = with_breaks(docs).select("doc_id", "threshold", F.posexplode("distances").alias("i", "distance"))
    return rows.select("doc_id", "i", "distance", "threshold", (F.col("distance") > F.col("threshold")).alias("is_break"))


def semantic_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_ord (from 1), chunk_id, text: sentences between breaks, one space between.

    A null or empty text has no chunks; a repeated document is chunked each time.
    """

    def above(limit: Column) -> Column:
        return F.transform(F.filter(F.transform("distances", lambda d, i: F.when(d > limit, i + 1)), lambda i: i.isNotNull()), lambda i: i.cast("int"))

    # The limit is an element of an array: as a column it would be put into the function and sorted out anew for each distance.
    last = F.transform(F.array(threshold(F.col("distances"))), above)[0]
    cut = with_distances(docs).select("doc_id", "sentences", F.concat(F.array(F.lit(0)), last, F.array(F.size("sentences"))).alias("ends"))
    texts = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda k: F.array_join(F.slice("sentences", F.get("ends", k - 1) + 1, F.get("ends", k) - F.get("ends", k - 1)), " "))
    out = cut.select("doc_id", F.posexplode(texts).alias("k", "text")).withColumn("chunk_ord", F.col("k") + 1)
    return out.select("doc_id", "chunk_ord", chunk_id(F.col("doc_id"), F.col("chunk_ord")).alias("chunk_id"), "text")
