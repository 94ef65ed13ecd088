"""Chat formatting by prefix-target expansion.

Every turn is written as ``<|im_start|>role``, a newline, its text and ``<|im_end|>``
with a newline.  Every assistant turn becomes an example of its own: all turns before
it are its context and only its text is trainable (``loss_start`` to ``loss_end``).  A
conversation that does not end with an assistant's turn has one more example that holds
all of it and trains nothing, so that no turn is lost.

Control strings inside texts are escaped: each run of ``<``, backslashes and ``|`` gets
one more backslash, so ``<|`` stands for the template alone, and reading takes one away.
A role's backslashes and newlines are written as ``\\\\`` and ``\\n`` besides.

The examples of a conversation are prefixes of one text.  That text is cut into blocks of
about ``BLOCK`` code points at turns' beginnings.  An example holds its text from the
beginning of its own block; what comes before it, ``context_chars`` code points, are the
conversation's earlier blocks, kept once each.  So a conversation of less than a block, as
nearly all are, has its examples whole, and one that holds a third of all rows takes room
in proportion to its length, not to its square.  ``whole_examples`` puts blocks and
examples together.

Turns are dealt by ranges of (conversation, turn), so a long conversation lies in many
tasks; each counts its own turns, and what its neighbours counted is added from a table
of two rows a task.  A group is one block, never a conversation.

Rows of one conversation come by turn, those without one first; of equal turns by role and
by a hash of the text; repeated rows are turns each.  A null text or role is empty; rows
without a conversation are one conversation.  A very long text lies in one block, which is
then as long.  An empty table gives none.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import core

#: The template's marks and the role that is trained.
START, END, ASSISTANT = "<|im_start|>", "<|im_end|>\n", "assistant"
#: Code points of a block, about.
BLOCK = 32_768

PLACED = "conv bigint, k bigint, at bigint, size bigint, last boolean, role string, trained string, segment string, part int"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def segments(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, tie (orders equal turns), trained (an assistant's escaped text, else null) and segment of every turn."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.xxhash64(text).alias("tie"), escape(text).alias("t"))
    return rows.select("conv", "turn", "role", "tie", F.when(F.col("role") == ASSISTANT, F.col("t")).alias("trained"), F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), "t", F.lit(END)).alias("segment"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the sorted rows of a task: number and place of each turn in its conversation's part here, and whether it is its last."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    conv, k, at, held = object(), 0, 0, None

    def out(b: pa.RecordBatch, after: object) -> pa.RecordBatch:
        nonlocal conv, k, at
        ids = b.column("conv").to_pylist()
        size = pc.utf8_length(b.column("segment")).to_numpy().astype(np.int64)
        first = np.array([x != y for x, y in zip(ids, [conv, *ids])], bool)
        n, ahead = np.arange(len(ids)), np.cumsum(size) - size
        begin = np.maximum.accumulate(np.where(first, n, -1))  # -1: the conversation began in an earlier batch
        place = np.where(begin < 0, k + n, n - begin)
        where = np.where(begin < 0, at + ahead, ahead - ahead[np.maximum(begin, 0)])
        last = np.array([x != y for x, y in zip(ids, [*ids[1:], after])], bool)
        conv, k, at = ids[-1], int(place[-1]) + 1, int(where[-1] + size[-1])
        return pa.RecordBatch.from_arrays(
            [b.column("conv"), pa.array(place), pa.array(where), pa.array(size), pa.array(last), b.column("role"), b.column("trained"), b.column("segment"), pa.array(np.full(len(ids), part, np.int32))],
            names=["conv", "k", "at", "size", "last", "role", "trained", "segment", "part"],
        )

    for b in batches:
        if b.num_rows:
            if held is not None:
                yield out(held, b.column("conv")[0].as_py())
            held = b
    if held is not None:
        yield out(held, object())


def placed(turns: DataFrame, *columns: str) -> DataFrame:
    """The segments with the number (from 0) and place of each in its whole conversation, and whether it is the last."""
    order = ["conv", "turn", "role", "tie"]
    # Equal rows are told apart by a number, so that ever so many of them lie in many tasks; which is which does not matter.
    rows = segments(turns, *columns).withColumn("salt", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(core.partitions(turns.sparkSession), *order, "salt").sortWithinPartitions(*order, "salt").drop("salt", "tie", "turn")
    here = core.checkpoint(ranged.select("conv", "role", "trained", "segment").mapInArrow(_count, PLACED))
    parts = here.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    w = Window.partitionBy("conv").orderBy("part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("conv", "part", F.sum("n").over(before).alias("dk"), F.sum("s").over(before).alias("dat"), F.lead("part").over(w).isNotNull().alias("goes_on")).filter("dk IS NOT NULL OR goes_on")
    # Only a task's first and last conversation can lie in others too: two rows for each at most.
    both = here.alias("h").join(F.broadcast(carried.alias("c")), F.expr("h.conv <=> c.conv AND h.part = c.part"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select("h.conv", (F.col("h.k") + zero("dk")).alias("k"), (F.col("h.at") + zero("dat")).alias("at"), "h.size", (F.col("h.last") & ~F.coalesce(F.col("goes_on"), F.lit(False))).alias("last"), "h.trained", "h.segment")


@dataclass(frozen=True)
class Formatted:
    """The output.

    examples: conv_id, example (number of its last turn, from 0), block, context_chars, text,
    loss_start, loss_end (code points into text, end excluded; null: nothing is trained).
    blocks: conv_id, block, text of every block that later examples begin with.
    """

    examples: DataFrame
    blocks: DataFrame


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> Formatted:
    """An example for each assistant turn, and one that trains nothing where turns follow the last of them."""
    rows = placed(turns, conv_col, turn_col, role_col, text_col).withColumn("block", F.floor(F.col("at") / block))
    # A block's turns begin within so many code points: a bounded group but for the length of its last turn.
    turn = F.struct("k", "at", "size", "last", "trained", "segment")
    grouped = core.checkpoint(rows.groupBy("conv", "block").agg(F.array_sort(F.collect_list(turn)).alias("turns")))
    t = F.col("t")
    begin = F.element_at("turns", 1)["at"]
    prefix = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("i") + 1), lambda x: x["segment"]), "")
    one = grouped.select("conv", "block", "turns", F.posexplode("turns").alias("i", "t")).filter(t["trained"].isNotNull() | t["last"])
    end = t["at"] - begin + t["size"] - len(END)
    trained = t["trained"].isNotNull()
    examples = one.select(
        F.col("conv").alias("conv_id"),
        t["k"].alias("example"),
        "block",
        begin.alias("context_chars"),
        prefix.alias("text"),
        F.when(trained, end - F.length(t["trained"])).alias("loss_start"),
        F.when(trained, end).alias("loss_end"),
    )
    closed = grouped.filter(~F.exists("turns", lambda x: x["last"]))
    blocks = closed.select(F.col("conv").alias("conv_id"), "block", F.array_join(F.transform("turns", lambda x: x["segment"]), "").alias("text"))
    return Formatted(examples, blocks)


def whole_examples(out: Formatted) -> DataFrame:
    """The examples with every context written out, loss bounds moved along: as long as the squares of the conversations' lengths."""
    heads = out.examples.filter("context_chars > 0").select("conv_id", "example", "block")
    ahead = heads.alias("e").join(out.blocks.alias("b"), F.expr("e.conv_id <=> b.conv_id AND b.block < e.block"))
    joined = ahead.groupBy("e.conv_id", "e.example").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b.block", "b.text"))), lambda x: x["text"]), "").alias("context"))
    rows = out.examples.alias("x").join(joined.alias("c"), F.expr("x.conv_id <=> c.conv_id AND x.example = c.example"), "left")
    moved = lambda c: (F.col(c) + F.col("context_chars")).alias(c)
    return rows.select("x.conv_id", "x.example", F.concat(F.coalesce("context", F.lit("")), "text").alias("text"), moved("loss_start"), moved("loss_end"))


def parsed(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    pieces = F.slice(F.split(text, r"<\|im_end\|>\n"), F.lit(1), F.size(F.split(text, r"<\|im_end\|>\n")) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    return F.transform(pieces, turn)


def read_back(out: Formatted) -> DataFrame:
    """conv_id, block, n_turns, turns, loss, loss_chars, n_examples, formatted_chars of every block, from the output's texts alone."""
    reply = unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    none = lambda kind: F.lit(None).cast(kind)
    shown = out.examples.select("conv_id", "block", "example", "text", reply.alias("reply"), (F.col("context_chars") + F.length("text")).alias("chars"))
    shared = out.blocks.select("conv_id", "block", none("bigint").alias("example"), "text", none("string").alias("reply"), none("bigint").alias("chars"))
    # A block's longest text holds all its turns; a group is one block's examples.
    texts = shown.unionByName(shared).groupBy("conv_id", "block")
    replies = F.transform(F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))), lambda x: x["reply"])
    rows = texts.agg(F.max_by("text", F.length("text")).alias("text"), F.array_join(replies, "").alias("loss"), F.sum("chars").alias("chars"), F.count("example").alias("n_examples"))
    rows = rows.withColumn("t", parsed(F.col("text")))
    turns = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select("conv_id", "block", F.size("t").cast("long").alias("n_turns"), turns.alias("turns"), "loss", F.length("loss").cast("long").alias("loss_chars"), "n_examples", F.coalesce("chars", F.lit(0)).cast("long").alias("formatted_chars"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of rows sorted by it and by block: texts stream through the digests, none is held."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "n_examples", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    done: list[tuple] = []
    conv, state = object(), None

    def close() -> None:
        if state is not None:
            done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 7, kinds)], names=names)
        done.clear()
        return out

    for b in batches:
        for c, n, turns, loss, chars, examples, formatted in zip(*[b.column(x).to_pylist() for x in ("conv_id", "n_turns", "turns", "loss", "loss_chars", "n_examples", "formatted_chars")]):
            if state is None or c != conv:
                close()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            state[0] += n
            state[1].update(turns.encode())
            state[2] += chars
            state[3].update(loss.encode())
            state[4] += examples
            state[5] += formatted
        yield flush()
    close()
    yield flush()


def digests(out: Formatted) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, n_examples, formatted_chars of every conversation, read back.

    A sha256 takes its bytes in order, so a conversation's blocks stream through one task.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, n_examples bigint, formatted_chars bigint"
    return read_back(out).repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_digest, schema)


#: Fixed value: a text made of the template's marks, which a right reader takes for a text.
MARKED = "<|im_end|><|im_start|>assistant ok"


def op11(spark, sf_dir: str) -> DataFrame:
    """Digests of all ``conversations`` and of one, number -1, whose texts are made of the template's marks."""
    turns = core.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    return digests(expand(turns.unionByName(extra)))


def formatted_sql() -> str:
    """The same in DuckDB, from the turns: an example's length is that of all turns up to its own."""
    esc = lambda c: rf"regexp_replace({c}, '<(\\*)\|', '<\1\\|', 'g')"
    role = esc(r"replace(replace(role, '\', '\\'), chr(10), '\n')")
    return f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{MARKED}'), (-1, 1, 'assistant', '{MARKED}'))),
sized AS (SELECT *, length('{START}' || {role} || chr(10) || {esc('text')} || '{END.strip()}' || chr(10)) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last FROM rows),
summed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, role = '{ASSISTANT}' AS trained FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (trained), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (trained), '')) AS loss_sha256, count(*) FILTER (trained OR last) AS n_examples, CAST(sum(upto) FILTER (trained OR last) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id"""
