"""The corpus pipeline: quality rules, near-dedup, suffix dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir), docs having the columns of ``documents``,
and returns a DataFrame; all but the last return those columns.  Between stages
rows are written and read again.

Every stage takes null ids and texts as its operator does, texts of any length whole,
repeated rows each (the near-dedup stage says which of them stays) and further columns of
any names, which it carries along; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcask.llm import core, near_dedup, packing, quality, secret_scan, suffix_dedup


def _row(docs: DataFrame) -> DataFrame:
    """All columns in one struct beside the text, so a stage's own names cannot clash with them."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["text"].alias("text"))


def _with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of __row with a new text, and n_chars to match where there is such a column."""
    new = {"text": F.col(text), "n_chars": F.length(F.col(text)).cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col("__row")[c].alias(c) for c in columns])


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule; the others go."""
    return quality.judge(_row(docs)).filter("kept").select("__row.*")


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id.

    Every row is judged for itself, by a number of its own: its id.  Of an id's several texts the
    one of the least hash has that number; the others, and rows without an id, have numbers after
    every id, made of id and text.  Of rows of one id and one text the one stays whose
    columns come first as JSON.
    """
    h = F.xxhash64("__text")
    after = F.lit(1 << 62) + F.xxhash64(docs["doc_id"], docs["text"]).bitwiseAND(F.lit((1 << 62) - 1))
    rows = docs.select(docs["doc_id"].cast("long").alias("__id"), after.alias("__after"), F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["text"].alias("__text"))
    again = rows.groupBy("__id").agg(F.count("*").alias("n"), F.min(h).alias("__first")).filter("n > 1 AND __id IS NOT NULL").select("__id", "__first")
    number = F.coalesce("__id", "__after")
    if again.limit(1).count():
        again = core.checkpoint(again)
        rows = rows.join(again, "__id", "left")
        number = F.when(F.col("__first").isNull() | h.eqNullSafe(F.col("__first")), F.col("__id")).otherwise(F.col("__after"))
        number = F.coalesce(number, F.col("__after"))
    rows = rows.select(number.alias("__num"), "__row", "__text")
    same = rows.groupBy("__num").count().filter("count > 1").select("__num")
    if same.limit(1).count():
        same = core.checkpoint(same)
        one = rows.join(same, "__num", "left_semi").groupBy("__num").agg(F.min_by(F.struct("__row", "__text"), F.to_json("__row")).alias("r")).select("__num", "r.__row", "r.__text")
        rows = core.checkpoint(rows.join(same, "__num", "left_anti").unionByName(one))
    judged = near_dedup.near_duplicates(rows, "__num", "__text")
    kept = judged.filter("kept").select(F.col("__num").alias("__kept"))
    return rows.join(kept, rows["__num"] == kept["__kept"], "left_semi").select("__row.*")


def suffix_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the byte strings that documents of smaller ids hold; whole characters only."""
    rows = docs.select("doc_id", F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["text"])
    slim = rows.withColumn("__row", F.col("__row").dropFields("text")) if len(docs.columns) > 1 else rows
    out = suffix_dedup.suffix_dedup(slim, carry=("__row",), characters=True)
    return _with_text(out.withColumn("__text", F.col("kept").cast("string")), docs.columns, "__text")


def secret_scan_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret's value masked."""
    rows = _row(docs).withColumn("__path", F.col("__row")["source"].cast("string") if "source" in docs.columns else F.lit(""))
    return _with_text(secret_scan.scan(rows, path_col="__path"), docs.columns, "masked")


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row for each piece, with its ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]
#: Token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = core.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = core.checkpoint(docs)
    return docs
