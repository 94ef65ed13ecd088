"""Lexical search: wide candidates by BM25, a re-rank by shared words, snippets, an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NOT_FOUND, overlap_tokens, snippet, strip
from . import bm25
from .segments import Index

ANSWERS = 5
ROLES = ("user", "assistant")
#: Queries whose candidates are sent to every task, at most.
SENT_QUERIES = 10_000


def candidates_for(top_k: int) -> int:
    return max(4 * top_k, 20)


def _ranked(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """query_id, doc_id, chunk_ord, overlap, rank, query, text of each query's best candidates.

    Candidates, a few for each query, go to the texts where they stand if the queries are few; texts are read once.
    """
    sent = F.broadcast if queries.limit(SENT_QUERIES + 1).count() <= SENT_QUERIES else lambda rows: rows
    rows = chunks.select("doc_id", "chunk_ord", "text").join(sent(candidates.join(queries, "query_id")), ["doc_id", "chunk_ord"])
    rows = rows.withColumn("asked", overlap_tokens(F.col("query"))).withColumn("overlap", F.size(F.array_intersect("asked", overlap_tokens(F.col("text")))))
    rows = rows.filter((F.col("overlap") > 0) | (F.size("asked") == 0))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.col("rank"))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top_k).select("query_id", "doc_id", "chunk_ord", "overlap", F.col("place").alias("rank"), "query", "text")


def rerank(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int = ANSWERS) -> DataFrame:
    """query_id, doc_id, chunk_ord, overlap, rank (from 1).

    Candidates without a shared word are dropped; more shared words come first, then
    the earlier candidate.  A query without words keeps the first candidates as they are.
    """
    return _ranked(candidates, chunks, queries, top_k).drop("query", "text")


def search(chunks: DataFrame, queries: DataFrame, top_k: int = ANSWERS, index: Index | None = None) -> DataFrame:
    """rerank of the candidates that a kept index of the chunks (or one made of them) gives."""
    return rerank(bm25.top_k(chunks, queries, candidates_for(top_k), index), chunks, queries, top_k)


def answers(chunks: DataFrame, queries: DataFrame, top_k: int = ANSWERS, index: Index | None = None) -> DataFrame:
    """query_id, answer: ranked snippets, a line each, or a fixed sentence."""
    hits = _ranked(bm25.top_k(chunks, queries, candidates_for(top_k), index), chunks, queries, top_k)
    lines = hits.select("query_id", "rank", F.concat(F.col("rank").cast("string"), F.lit(") "), snippet(F.col("text"), F.col("query"))).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
    found = lines.groupBy("query_id").agg(text.alias("answer"))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(NOT_FOUND)).alias("answer"))


def validate_chat(requests: DataFrame) -> DataFrame:
    """The input (…, role, message) with the stripped message and why it is refused, if it is."""
    text = strip(F.coalesce("message", F.lit("")))
    reason = F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), F.lit("unknown role")).when(text == "", F.lit("message is required"))
    return requests.withColumn("message", text).withColumn("reject_reason", reason)
