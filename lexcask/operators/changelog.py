"""The corpus change log: append, range scans, net effect, cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .events import OPS


def latest_change_id(log: DataFrame) -> DataFrame:
    """One row; 0 for an empty log."""
    return log.agg(F.coalesce(F.max("change_id"), F.lit(0)).cast("long").alias("latest_change_id"))


def changes_since(log: DataFrame, cursor: int) -> DataFrame:
    """Changes after a cursor; the comparison reaches the scan."""
    return log.filter(F.col("change_id") > cursor)


def net_changes(changes: DataFrame) -> DataFrame:
    """doc_id, op: the last valid change of each document."""
    return changes.filter((F.coalesce("doc_id", F.lit("")) != "") & F.col("op").isin(*OPS)).groupBy("doc_id").agg(F.max_by("op", "change_id").alias("op"))


def advance_cursor(log: DataFrame, cursor: int) -> DataFrame:
    """The cursor after a read: over all rows, valid or not; unmoved if there are none."""
    return changes_since(log, cursor).agg(F.coalesce(F.max("change_id"), F.lit(cursor)).cast("long").alias("cursor"))


def is_stale(log: DataFrame, cursor: int) -> DataFrame:
    return latest_change_id(log).select((F.col("latest_change_id") != cursor).alias("is_stale"))


def append(log: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New changes with the ids after the log's last, in the given order.

    For the single writer of a micro-batch.  Ids come from counts of each
    partition and places within it, not from one window over all rows.
    """
    ranged = new.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id())
    within = Window.partitionBy("__p").orderBy(order)
    placed = ranged.withColumn("__k", F.row_number().over(within))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    return placed.join(before, "__p").crossJoin(F.broadcast(latest_change_id(log))).select((F.col("latest_change_id") + F.col("__before") + F.col("__k")).cast("long").alias("change_id"), "doc_id", "op")
