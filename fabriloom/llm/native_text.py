"""Text normalisation in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z as a-z, joined by single blanks; null: empty."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def words_of(plain_text: Column) -> Column:
    return F.when(plain_text == "", F.array().cast("array<string>")).otherwise(F.split(plain_text, " "))


def count_words(plain_text: Column) -> Column:
    return F.when(plain_text == "", F.lit(0)).otherwise(F.length(plain_text) - F.length(F.replace(plain_text, F.lit(" "), F.lit(""))) + 1).cast("long")
