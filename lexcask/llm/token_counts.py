"""Exact token counts for every context limit, from one histogram of lengths.

Workers encode documents and give one length each; the lengths are counted in
Spark (partially before the shuffle), so only as many rows as there are distinct
lengths go on.  Sums over all longer (or shorter) lengths then answer any limit:
how many documents and tokens there are, where a quantile lies, and how many
tokens are left if documents are cut at the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import core, tokens

#: Lengths are summed in blocks of so many first, so no window holds them all.
BLOCK = 4096


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.coder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.column(0).slice(lo, 1024).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in coder.encode(part)], pa.int64())], ["n_tokens"])

    return run


def lengths(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """n_tokens of each document; a null text has none.

    Repeated rows count each, a text of any length is encoded whole, an empty table
    gives no rows, and other columns (ids too, null or not) are not read.
    """
    return docs.select(docs[text_col].alias("text")).mapInArrow(_lengths(tokenizer or tokens.byte_bpe_path()), "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a limit: exact totals on either side.

    n_tokens, n_docs, n_tokens_total (of these documents); docs_le, tokens_le;
    docs_gt, tokens_gt; truncated_total (tokens left if each document is cut to
    n_tokens); share_le (of all documents).  An empty input gives no rows.
    """
    h = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("n_tokens_total", F.col("n_docs") * F.col("n_tokens"))
    # Read twice below; texts are encoded once.
    h = core.checkpoint(h.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens_total").alias("t"))
    # A row for every 4096 lengths that occur: a document of 10 GB is the bound of 2.5 million of them.
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    before = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(every), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("t").over(every), F.lit(0)).alias("t0"),
        F.sum("d").over(whole).alias("d_all"),
        F.sum("t").over(whole).alias("t_all"),
    )
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(before, "block").select(
        "n_tokens",
        "n_docs",
        "n_tokens_total",
        (F.col("d0") + F.sum("n_docs").over(within)).alias("docs_le"),
        (F.col("t0") + F.sum("n_tokens_total").over(within)).alias("tokens_le"),
        "d_all",
        "t_all",
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "n_tokens_total",
        "docs_le",
        "tokens_le",
        (F.col("d_all") - F.col("docs_le")).alias("docs_gt"),
        (F.col("t_all") - F.col("tokens_le")).alias("tokens_gt"),
        (F.col("tokens_le") + (F.col("d_all") - F.col("docs_le")) * F.col("n_tokens")).alias("truncated_total"),
        (F.col("docs_le") / F.col("d_all")).alias("share_le"),
    )


def totals_at(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, truncated_total, docs_over: exact for any limits, also such as no document has; no limits give no rows."""
    if not limits:
        return hist.sparkSession.createDataFrame([], "limit long, truncated_total long, docs_over long")
    rows = ", ".join(f"({int(x)}L)" for x in limits)
    few = hist.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS v(limit)")
    # Each length meets each of the given few limits, before the sum.
    return (
        hist.select("n_tokens", "n_docs")
        .withColumn("limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
        .groupBy("limit")
        .agg(F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("truncated_total"), F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_over"))
        .join(few, "limit", "right")
        .na.fill(0)
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that at least this share of documents does not exceed."""
    return (
        hist.select("n_tokens", "share_le")
        .withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
        .filter("share_le >= share")
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )


def op5(spark, sf_dir):
    return histogram(lengths(core.table(spark, sf_dir, "documents")))
