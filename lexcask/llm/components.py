"""Connected components by alternating stars, for graphs larger than a machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

#: Rounds after which it raises, never returning half a result; stars need about the logarithm of the longest path.
ROUNDS = 50
#: Rows of one vertex that a task joins, about, or a small part of a task's share if that is more.
SALT = 256


def _tie(rows: DataFrame, least: DataFrame, many: int) -> DataFrame:
    """rows (a, b) with m of least (a, m, n) added; a vertex of more than ``many`` rows is dealt to copies of its m.

    So many rows have less than 2 * edges / many vertices, which ``components`` bounds by the number of partitions.
    """
    salts = F.ceil(F.col("n") / many).cast("int")
    hot = least.filter(F.col("n") > many).select("a", salts.alias("salts"))
    left = rows.join(F.broadcast(hot), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0)).cast("int").alias("salt"))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > many, salts - 1).otherwise(0)))
    return left.join(least.select("a", "m", copies.alias("salt")), ["a", "salt"])


def _large(edges: DataFrame, many: int) -> DataFrame:
    """Each vertex's greater neighbours are tied to its least one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return _tie(both, least, many).filter("b > a").select(F.col("m").alias("a"), "b").filter("a != b").distinct()


def _small(edges: DataFrame, many: int) -> DataFrame:
    """Each vertex and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return _tie(down, least, many).select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """vertex, component (its least vertex) of every vertex in the links (a, b), of which there are at most ``most`` if that is known.

    Every round goes to files in the shared folder, so the plan stays short and a
    lost executor costs one round; the round before is removed.  Files follow the
    number of edges, which no round raises above that of edges and vertices.
    """
    edges = core.checkpoint(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), most)

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(ROUNDS):
        if not before[0]:
            break
        many = max(SALT, before[0] // (4 * core.partitions(links.sparkSession)))
        new = core.checkpoint(_small(_large(edges, many), many), 3 * before[0])
        core.release(edges)
        edges, now = new, state(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # Now every edge ties a vertex to the least of its component.
    ties = edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("vertex"), "component")
    return ties.unionByName(edges.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct())
