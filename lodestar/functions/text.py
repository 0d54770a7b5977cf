"""Text expressions. All take and return Columns and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of a-z and 0-9 with no other letter, digit or underscore beside it.
TOKEN_PATTERN = r"(?<![\p{L}\p{N}_])([a-z0-9]+)(?![\p{L}\p{N}_])"
#: Text is cut after . ! or ? followed by white space.
SENTENCE_PATTERN = r"(?U)(?<=[.!?])\s+"
SLICE_WORDS = 64
PREVIEW_CHARS = 120


def tokenize(text: Column) -> Column:
    """Lower-cased tokens in order; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_sentences(text: Column) -> Column:
    """The non-empty sentences in order; an empty array for null."""
    parts = F.split(strip(F.coalesce(text, F.lit(""))), SENTENCE_PATTERN)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)(\S+)"), 1)


def word_count(text: Column) -> Column:
    """The default token counter; any function of a text column to a count can take its place."""
    return F.size(words(text)).cast("long")


def word_slices(text: Column, size: int = SLICE_WORDS) -> Column:
    """Consecutive slices of so many words, joined by a space."""

    def cut(ws: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ws), F.lit(size)), lambda i: i < F.size(ws))
        return F.transform(starts, lambda i: F.array_join(F.slice(ws, i + 1, size), " "))

    # a lambda's argument is made once; an expression in its body would find the words anew for each slice
    return F.get(F.transform(F.array(words(text)), cut), 0)


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    """At most so many characters, with three dots where something was cut."""
    return F.when(F.char_length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def contains_any(text: Column, keywords: Column) -> Column:
    """Whether the lower-cased text holds any of an array of keywords."""
    return F.exists(keywords, lambda k: F.contains(F.lower(text), F.lower(k)))
