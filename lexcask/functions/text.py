"""Column functions over text: all built-in expressions, no user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space (Unicode White_Space and the four separators U+001C to U+001F).
SPACE_CLASS = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SNIPPET_CHARS = 280
NOT_FOUND = "I couldn't find relevant content for that query in the indexed documents."


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def normalize_whitespace(c: Column) -> Column:
    """One space between words and none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE_CLASS}+", " "))


def ws_tokens(c: Column) -> Column:
    """Words as they stand, for the lexical index."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{SPACE_CLASS}+"), lambda w: w != "")


def word_tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def overlap_tokens(c: Column) -> Column:
    """Distinct word tokens, for the re-rank."""
    return F.array_distinct(word_tokens(c))


def snippet(text: Column, query: Column, max_chars: int = SNIPPET_CHARS) -> Column:
    """A window of the text from a third of it before the first hit of any query term of two letters or more.

    A hit is a substring of the lower-cased text; without one the text's beginning
    is taken.  An ellipsis follows whenever the result is shorter than the text.
    """
    body = F.coalesce(text, F.lit(""))

    def of(low: Column) -> Column:
        terms = F.filter(word_tokens(query), lambda t: F.length(t) > 1)
        hits = F.filter(F.transform(terms, lambda t: F.call_function("locate", t, low)), lambda p: p > 0)
        start = F.greatest(F.lit(0), F.coalesce(F.array_min(hits), F.lit(1)) - 1 - max_chars // 3)
        return F.substring(body, start + 1, F.lit(max_chars))

    cut = F.transform(F.array(F.lower(body)), of)[0]
    out = strip(cut)
    return F.when(F.length(out) < F.length(body), F.concat(out, F.lit("..."))).otherwise(out)


def decode_utf8(content: Column) -> Column:
    """Bytes as text, with U+FFFD where they are not valid."""
    return F.call_function("make_valid_utf8", content.cast("string"))
