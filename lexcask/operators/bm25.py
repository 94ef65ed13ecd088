"""Okapi BM25 over chunks (doc_id, chunk_ord, text), by joins on a kept index of blocks.

Terms are words as they stand.  Scores are rounded before they are ranked, and ties go by
document and chunk, so the order is total.

Where the queries' words stand in many chunks, the best ``k`` are found without scoring
all of them.  A query's rarest words give ``k`` chunks whose least whole score is a floor.
Words are then taken by what they can add at most: those that together stay below a share
of the floor cannot lift a chunk over it, so only chunks that hold one of the others come
into question, of those only blocks whose own bound, with all other words at their most,
reaches the floor, and of those only chunks that have the rest of the floor by the others.
The frequent words are looked up for what is left, in the blocks where it lies.  All bounds
are over non-negative weights; where a word's weight is negative (the mean of all idf is,
as in tiny corpora) every word is taken in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ws_tokens
from ..sources.scratch import shared_folder
from . import segments
from .segments import Index

# The usual constants.
K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 6
#: Different terms of all queries that are sent to every task, at most.
SENT_TERMS = 200_000
#: Postings of all queries' words from which bounds are worth their passes; fewer are scored at once, with the same result.
PRUNE_FROM = 5_000_000_000
#: Postings that a task scores, about: what it holds follows them, and the number of tasks follows the postings.
TASK_POSTINGS = 1_000_000
#: The share of a query's postings, of its rarest words, that its floor is taken from.
RARE = 0.05
#: The share of the floor that words may add together which are only looked up.
SPARED = 0.6
#: What rounding may have moved a score by, and sums of bounds.
MARGIN = 2e-6


def doc_stats(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_ord, dl of every chunk."""
    return chunks.select("doc_id", "chunk_ord", F.size(ws_tokens(F.col("text"))).cast("long").alias("dl"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n_chunks, avgdl (null for an empty corpus)."""
    return doc_stats(chunks).agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"))


def with_idf(df: DataFrame, n_chunks: Column | int, mean: Column) -> DataFrame:
    """term, df, idf of terms counted over ``n_chunks``; a negative idf becomes a quarter of the mean over all terms."""
    idf = segments.raw_idf(F.col("df"), n_chunks)
    return df.select("term", "df", F.when(idf < 0, EPSILON * mean).otherwise(idf).alias("idf"))


def term_stats(chunks: DataFrame) -> DataFrame:
    """term, df, idf of a corpus without an index."""
    df = chunks.select(F.explode(F.array_distinct(ws_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    counted = df.crossJoin(F.broadcast(corpus_stats(chunks)))
    mean = counted.agg(F.avg(segments.raw_idf(F.col("df"), F.col("n_chunks"))).alias("mean"))
    return with_idf(counted.crossJoin(F.broadcast(mean)), F.col("n_chunks"), F.col("mean"))


def index_term_stats(index: Index, terms: DataFrame | None = None) -> DataFrame:
    """term, df, idf of an index, of all terms or those given."""
    return with_idf(index.df(terms), index.state.n_chunks, F.lit(index.state.mean_idf).cast("double"))


def _kept(rows: DataFrame, folder: str) -> DataFrame:
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


class Search:
    """One set of queries (query_id, query) against an index."""

    def __init__(self, index: Index, queries: DataFrame, k: int, prune_from: int = PRUNE_FROM):
        self.index, self.queries, self.k = index, queries, k
        self.folder = shared_folder(index.spark, "search")
        state = index.state
        self.avgdl = state.n_words / state.n_chunks if state.n_chunks and state.n_words else 1.0
        asked = queries.select("query_id", F.explode(ws_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        asked = _kept(asked, f"{self.folder}/asked")
        terms = asked.select("term").distinct()
        n_terms, slots = terms.agg(F.count("*"), F.collect_set(segments.slot(F.col("term")))).first()
        #: A table of the queries' terms goes to every task if it is small, else it is joined.
        self.few = n_terms <= SENT_TERMS
        self.sent = F.broadcast if self.few else lambda rows: rows
        self.blocks = index.blocks(slots).join(self.sent(terms), "term", "left_semi")
        bound = self.blocks.groupBy("term").agg(F.max(self.tf_weight(F.col("max_tf"), F.col("min_dl"))).alias("most"))
        weighed = asked.join(self.sent(index_term_stats(index, self.sent(terms)).join(bound, "term")), "term")
        #: query_id, term, w (weight of the term in the query), df, ub (what it can add to a chunk at most).
        self.weights = _kept(weighed.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "df", (F.col("qtf") * F.col("idf") * F.col("most")).alias("ub")), f"{self.folder}/weights")
        least, postings = self.weights.agg(F.min("w"), F.sum("df")).first()
        self.n_tasks = max(1, -(-(postings or 0) // TASK_POSTINGS))
        self.negative = least is not None and least < 0
        self.prune = not self.negative and (postings or 0) >= prune_from

    def tf_weight(self, tf: Column, dl: Column) -> Column:
        return (K1 + 1) * tf / (tf + K1 * (1 - B + B * dl / F.lit(self.avgdl)))

    def dealt(self, terms: DataFrame) -> DataFrame:
        """The blocks of ``terms`` with their columns, dealt by ``run`` of chunks: all that a chunk scores is summed where its run lies.

        Blocks are exchanged, not the postings in them, before the terms are tied to queries if these are sent.
        """
        # One column of both: a lone segment's number is a constant, by which Spark takes rows not to be dealt.
        blocks = self.blocks.withColumn("run", F.xxhash64("seg", "block"))
        if self.few:
            return blocks.repartition(self.n_tasks, "run").join(F.broadcast(terms), "term")
        return blocks.join(terms, "term").repartition(self.n_tasks, "run")

    def postings(self, blocks: DataFrame, *keep: str) -> DataFrame:
        """seg, n, part (what the term adds) of every chunk in blocks that have w."""
        rows = blocks.select(*keep, "seg", "w", F.explode(F.arrays_zip("ns", "tfs", "dls")).alias("p"))
        return rows.select(*keep, "seg", F.col("p.ns").alias("n"), (F.col("w") * self.tf_weight(F.col("p.tfs"), F.col("p.dls"))).alias("part"))

    def looked_up(self, pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """query_id, seg, n, s: what ``terms`` (query_id, term, w) add to the chunks of ``pairs`` (query_id, seg, n); only blocks where these lie are opened."""
        asked = pairs.select("query_id", "seg", "n").join(self.sent(terms.select("query_id", "term", "w")), "query_id")
        places = asked.select("term", "seg", F.floor(F.col("n") / segments.BLOCK).cast("long").alias("block")).distinct()
        near = self.blocks.join(places, ["term", "seg", "block"], "left_semi").select("term", "seg", F.explode(F.arrays_zip("ns", "tfs", "dls")).alias("p"))
        near = near.select("term", "seg", F.col("p.ns").alias("n"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        return asked.join(near, ["term", "seg", "n"]).groupBy("query_id", "seg", "n").agg(F.sum(F.col("w") * self.tf_weight(F.col("tf"), F.col("dl"))).alias("s"))

    def floors(self) -> DataFrame:
        """query_id, floor: the least whole score of the k best chunks by the rarest words alone; queries whose rarest words stand in fewer chunks have none."""
        w = Window.partitionBy("query_id")
        before = F.coalesce(F.sum("df").over(w.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        some = self.weights.withColumn("before", before).withColumn("sum", F.sum("df").over(w)).filter(F.col("before") < F.greatest(F.lit(4 * self.k), RARE * F.col("sum")))
        parts = self.index.alive(self.postings(self.blocks.join(self.sent(some.select("query_id", "term", "w")), "term"), "query_id"))
        scored = parts.groupBy("query_id", "seg", "n").agg(F.sum("part").alias("s"))
        best = scored.withColumn("place", F.row_number().over(w.orderBy(F.desc("s")))).filter(F.col("place") <= self.k)
        best = _kept(best.select("query_id", "seg", "n"), f"{self.folder}/best")
        return self.looked_up(best, self.weights).groupBy("query_id").agg(F.min("s").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == self.k).select("query_id", "floor")

    def terms(self) -> DataFrame:
        """The weights with floor, whether a term is needed to reach it, the bounds of those that are not, and of all.

        Those that are not needed stay below a share of the floor together, so that a chunk must have the rest of it by the others.
        """
        if not self.prune:
            return self.weights.select("*", F.lit(float("-inf")).alias("floor"), F.lit(True).alias("needed"), F.lit(0.0).alias("rest"), F.lit(float("inf")).alias("all"))
        w = Window.partitionBy("query_id")
        rows = self.weights.join(F.broadcast(self.floors()), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        upto = F.sum("ub").over(w.orderBy("ub", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("needed", (upto >= SPARED * F.col("floor")) | (F.col("floor") < 0))
        return rows.withColumn("rest", F.coalesce(F.sum(F.when(~F.col("needed"), F.col("ub"))).over(w), F.lit(0.0))).withColumn("all", F.sum("ub").over(w))

    def reached(self, blocks: DataFrame) -> DataFrame:
        """Blocks of needed terms of which some chunk may reach the floor, with its other words at their most."""
        most = F.col("w") * self.tf_weight(F.col("max_tf"), F.col("min_dl"))
        return blocks.filter(F.col("needed") & (most + F.col("all") - F.col("ub") + MARGIN >= F.col("floor")))

    def partial(self, terms: DataFrame) -> DataFrame:
        """query_id, seg, n, s by the needed words of chunks that may reach the floor."""
        rows = self.reached(self.dealt(terms.filter("needed")))
        found = self.postings(rows, "query_id", "run", "floor", "rest").groupBy("query_id", "run", "seg", "n").agg(F.sum("part").alias("s"), F.first("floor").alias("floor"), F.first("rest").alias("rest"))
        return self.index.alive(found.filter(F.col("s") + F.col("rest") + MARGIN >= F.col("floor")).select("query_id", "seg", "n", "s"))

    def scores(self) -> DataFrame:
        """query_id, seg, n, score of every chunk that can be among a query's best; all that hold a word where there is no floor."""
        if not self.prune:
            found = self.postings(self.dealt(self.weights), "query_id", "run").groupBy("query_id", "run", "seg", "n").agg(F.sum("part").alias("s"))
            return self.index.alive(found).select("query_id", "seg", "n", F.round("s", DIGITS).alias("score"))
        terms = _kept(self.terms(), f"{self.folder}/terms")
        found = _kept(self.partial(terms), f"{self.folder}/found")
        more = self.looked_up(found, terms.filter("NOT needed"))
        found = found.unionByName(more).groupBy("query_id", "seg", "n").agg(F.sum("s").alias("s"))
        return found.select("query_id", "seg", "n", F.round("s", DIGITS).alias("score"))

    def top(self) -> DataFrame:
        """query_id, doc_id, chunk_ord, score, rank (from 0) of each query's best chunks.

        Chunks without any of its words score 0 and fill up what is missing, in their order: with
        scores of 0 and more among the first 2 * k chunks, else among as many more as hold a word.
        """
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "chunk_ord")
        docs = self.index.docs().select("seg", "n", "doc_id", "chunk_ord")
        hits = self.scores()
        if not self.negative:  # a score of 0 is that of chunks without a word; equal scores stay together until documents are known
            hits = hits.filter("score > 0")
            hits = hits.withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("place") <= self.k)
        hits = _kept(hits.join(docs, ["seg", "n"]).select("query_id", "doc_id", "chunk_ord", "score"), f"{self.folder}/hits")
        best = hits.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < self.k).drop("rank")
        held = hits.groupBy("query_id").agg(F.count("*").alias("held"))
        short = self.queries.select("query_id").join(held, "query_id", "left").select("query_id", F.coalesce("held", F.lit(0)).alias("held"))
        if not self.negative:  # a query with k hits needs nothing else
            short = short.filter(F.col("held") < self.k)
        some = 2 * self.k if not self.negative else self.k + (held.agg(F.max("held")).first()[0] or 0)
        first = docs.orderBy("doc_id", "chunk_ord").limit(some).select("doc_id", "chunk_ord")
        fill = short.select("query_id").crossJoin(first).join(hits.select("query_id", "doc_id", "chunk_ord"), ["query_id", "doc_id", "chunk_ord"], "left_anti").withColumn("score", F.lit(0.0))
        return best.unionByName(fill.select(*best.columns)).withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < self.k)

    def postings_read(self) -> tuple[int, int]:
        """Postings of the queries' words that are read once there is a floor, and all of them, each query counted for itself."""
        terms = _kept(self.terms(), f"{self.folder}/counted")
        every = self.blocks.join(self.sent(terms), "term")
        places = self.partial(terms).select("query_id", "seg", F.floor(F.col("n") / segments.BLOCK).cast("long").alias("block")).distinct()
        looked = every.filter("NOT needed").join(places, ["query_id", "seg", "block"], "left_semi")
        count = lambda rows: rows.agg(F.sum(F.size("ns"))).first()[0] or 0
        return count(self.reached(every)) + count(looked), count(every)


def index_of(chunks: DataFrame) -> Index:
    """A new index of chunks in a folder of this run."""
    return segments.build(chunks, shared_folder(chunks.sparkSession, "index"))


def top_k(chunks: DataFrame, queries: DataFrame, k: int = 20, index: Index | None = None) -> DataFrame:
    """query_id, doc_id, chunk_ord, score, rank (from 0) of each query's best ``k`` chunks, by a kept index or one made of the chunks."""
    return Search(index or index_of(chunks), queries, k).top()
