"""Quality rules: a table of thresholds compiled into one Spark projection.

All measures of a text are column expressions over its own row (no join, no
exchange, no user function); the table's rows compile into one boolean.  Ratios
are compared as products of whole numbers, so every engine decides alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it on as with for was be by this are or an at from not "
    "le la les de des du et un une en est que qui dans pour sur au par pas "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als "
    "el los y se del las por con para su al es no"
).split()


@dataclass(frozen=True)
class Rule:
    """``100 * measure`` must be at least ``low`` and at most ``high`` hundredths of ``per``."""

    measure: str
    per: str
    low: int | None = None
    high: int | None = None

    def passes(self) -> Column:
        value, unit, ok = F.col(self.measure) * 100, F.col(self.per), F.lit(True)
        if self.low is not None:
            ok = ok & (value >= unit * self.low)
        if self.high is not None:
            ok = ok & (value <= unit * self.high)
        return ok


#: Measures are set on labelled documents of sf0.1: of those of quality 1 with 50 words or more all pass, of quality 0 none.
RULES = (
    Rule("word_chars", "n_words", 300, 1000),  # 3 to 10 characters a word
    Rule("n_symbols", "n_words", None, 10),
    Rule("n_stop_words", "n_words", 5, None),
    Rule("n_dup_lines", "n_lines", None, 40),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words within 3-word windows that occur twice or more, from the words' hashes."""

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    def covered(at: Column) -> Column:
        """Length of the union of [p, p + 3) over rising places p."""
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
            lambda s: s["n"],
        )

    def repeats(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return _let(
            placed,
            lambda s: covered(
                F.array_sort(
                    F.transform(
                        F.filter(s, lambda e, j: F.coalesce((F.get(s, j + 1)["x"] == e["x"]) | ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["x"] == e["x"])), (j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["x"] == e["x"]))),
                        lambda e: e["i"],
                    )
                )
            ),
        )

    return _let(hashes, lambda h: _let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(repeats(w))))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with __text, __words and every measure; a null text has none of anything."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.withColumn("__text", text).withColumn("__words", F.filter(F.split("__text", SPACE), lambda w: w != ""))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    second = first.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.concat_ws("", "__words")).cast("long"),
            "n_symbols": F.regexp_count("__text", F.lit(SYMBOLS)).cast("long"),
            "__lines": n_lines,
            "n_repeat_words": _repeat_words(F.transform("__words", lambda w: F.xxhash64(w))).cast("long"),
            "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        }
    )
    return second.withColumns({"n_lines": F.col("__lines.n").cast("long"), "n_dup_lines": F.col("__lines.dup").cast("long")}).drop("__lines")


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """The input with its measures, base_failed and kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat``
    hundredths of them in repeated 3-word windows.  kept: not base_failed and every
    rule passes.

    Nulls: a null text has no words, so it fails.  Input columns that have the name
    of a measure are replaced (put them in a struct to keep them, as the pipeline
    does).  Repeated rows are judged each.  An empty table gives none; a text of any
    length is judged whole.
    """
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    passes = F.lit(True)
    for r in rules:
        passes = passes & r.passes()
    return measures(docs, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes).drop("__text", "__words")


def op6(spark, sf_dir):
    docs = core.table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_sql(table: str = "documents") -> str:
    """DuckDB SQL of the same measures and verdicts over a table of doc_id and text."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = []
    for r in RULES:
        if r.low is not None:
            tests.append(f"{r.measure} * 100 >= {r.per} * {r.low}")
        if r.high is not None:
            tests.append(f"{r.measure} * 100 <= {r.per} * {r.high}")
    return f"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}
), wins AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM wins) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT words.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    coalesce(covered.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id
), n AS (
  SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM m
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept
FROM f
"""
