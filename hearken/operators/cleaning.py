"""From raw reviews to the clean, deduplicated, tokenised table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.functions import text
from hearken.functions.fixed_values import MIN_REVIEW_LENGTH, STOPWORDS


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of every key in the given order.

    Spark turns `row_number() <= 1` into a group limit that already runs before the shuffle, so a
    key that holds a large share of all rows sends one row per map task. The leading hash makes
    most comparisons of long text keys a comparison of two longs.
    """
    window = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank <= 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """At most n rows per key, best first; limited before the shuffle as well."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def long_enough(df: DataFrame, min_length: int = MIN_REVIEW_LENGTH) -> DataFrame:
    """Rows with cleaned text of a minimum length.

    Cleaning whole texts is the expensive step. Filters are not pushed below a generated column,
    so the text is cleaned once and not again for every filter on it.
    """
    others = [c for c in df.columns if c != "review"]
    once = F.explode(F.array(text.clean_text(F.col("review")))).alias("review")
    return df.select(*others, once).filter(F.length("review") >= min_length)


def clean_reviews(
    df: DataFrame,
    stopwords: Iterable[str] = STOPWORDS,
    min_length: int = MIN_REVIEW_LENGTH,
) -> DataFrame:
    """Clean text, drop short and repeated reviews, keep rows that still have tokens.

    The length filter runs before the shuffle of the deduplication. Equal texts have equal tokens,
    so the optimizer may run the token filter before it as well.
    """
    unique = first_per_key(long_enough(df, min_length), ["review"], ["seq"])
    return unique.withColumn("tokens", text.tokens(F.col("review"), stopwords)).filter(
        F.size("tokens") > 0
    )


def token_counts(df: DataFrame, stopwords: Iterable[str], min_word: int = 2) -> DataFrame:
    """How often each token occurs; stopwords are compared in lower case."""
    words = text.without(F.split("review", " "), stopwords, ignore_case=True)
    return (
        df.select(F.explode(words).alias("word"))
        .filter(F.length("word") >= min_word)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("freq"))
    )
