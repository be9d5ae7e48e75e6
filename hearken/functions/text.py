"""Text cleaning, tokens and pattern flags as JVM-side expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearken.functions.fixed_values import CLEAN_KEEP, MARKUP

WORD_RUN = r"([\p{L}\p{N}_]{2,})"  # maximal runs of two or more word characters


def clean_text(text: Column) -> Column:
    """Keep Hangul syllables, ASCII letters and digits; everything between them is one space."""
    return F.trim(F.regexp_replace(text, f"[^{CLEAN_KEEP}]+", " "))


def strip_tags(markup: Column) -> Column:
    return F.regexp_replace(markup, MARKUP, "")


def without(words: Column, stopwords: Iterable[str], ignore_case: bool = False) -> Column:
    """Drop empty strings and stopwords from an array of words."""
    stop = sorted(set(stopwords) | {""})

    def keep(word: Column) -> Column:
        return ~(F.lower(word) if ignore_case else word).isin(stop)

    return F.filter(words, keep)


def tokens(clean: Column, stopwords: Iterable[str]) -> Column:
    """White-space tokens of cleaned text minus stopwords."""
    return without(F.split(clean, " "), stopwords)


def words(text: Column) -> Column:
    """Lower-cased vectoriser words of any text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), 1)


def one_and_two_grams(run: Column) -> Column:
    """The words followed by the pairs of neighbours."""
    pairs = F.zip_with(
        F.slice(run, 1, F.greatest(F.size(run) - 1, F.lit(0))),
        F.slice(run, 2, F.greatest(F.size(run) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(run, pairs)


def matches(text: Column, pattern: str) -> Column:
    """Pattern test that is never NULL; \\s, \\w and \\b cover Unicode."""
    return F.coalesce(text.rlike("(?U)" + pattern), F.lit(False))


def head(text: Column, n: int) -> Column:
    """The first n characters, as a report cell shows them."""
    return F.substring(text, 1, n)
