"""Tokenizing documents and turning query text into term slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Anything that is neither alphabetic nor numeric in Unicode separates words.
WORD_BREAK = r"[^\p{IsAlphabetic}\p{N}]+"


def tokens(content: Column) -> Column:
    """Lower-cased words of a document in order; NULL content has none."""
    words = F.split(F.lower(F.coalesce(content, F.lit(""))), WORD_BREAK)
    return F.array_remove(words, "")


def query_slots(text: Column) -> Column:
    """Slots of an all-words query whose last word matches by prefix.

    Returns ``array<struct<term, is_prefix>>`` without repeats; text with no
    words has no slots and therefore matches nothing.
    """
    words = tokens(text)
    exact = F.transform(
        F.array_distinct(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))),
        lambda w: F.struct(w.alias("term"), F.lit(False).alias("is_prefix")),
    )
    last = F.transform(
        F.slice(words, F.greatest(F.size(words), F.lit(1)), F.lit(1)),
        lambda w: F.struct(w.alias("term"), F.lit(True).alias("is_prefix")),
    )
    return F.concat(exact, last)


def is_hybrid(text: Column) -> Column:
    """A search uses the text leg when its trimmed text is not empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\p{IsWhite_Space}+", "") != ""


def one_line(text: Column) -> Column:
    """Extracted file text with newlines as spaces."""
    return F.replace(text, F.lit("\n"), F.lit(" "))
