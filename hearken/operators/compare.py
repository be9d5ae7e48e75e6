"""Comparing the ratings of several apps over a shared period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions import hashing, text
from hearken.functions.fixed_values import RESET_SIGNAL
from hearken.functions.numeric import percent, round_even
from hearken.sources import snapshots

RATINGS = [1, 2, 3, 4, 5]


def one_table(*apps: tuple[str, DataFrame]) -> DataFrame:
    """Stack per-app review tables, stamping the app name."""
    stacked = None
    for name, df in apps:
        stamped = df.withColumn("app", F.lit(name))
        stacked = stamped if stacked is None else stacked.unionByName(stamped, True)
    return stacked


def common_period(df: DataFrame, date: str, app: str = "app", upper: bool = False) -> DataFrame:
    """Rows from the day on which every app has data; with `upper`, also until the last such day.

    The bounds are scalar subqueries over one row per app.
    """
    spans = df.groupBy(app).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    kept = df.filter(F.col(date) >= spans.agg(F.max("lo")).scalar())
    return kept.filter(F.col(date) <= spans.agg(F.min("hi")).scalar()) if upper else kept


def monthly_trend(df: DataFrame, date: str) -> DataFrame:
    """Month by app: reviews, share of one-star ratings, mean rating."""
    month = F.date_trunc("month", F.col(date)).cast("date")
    one_star = F.count_if(F.col("rating") == 1)
    return df.groupBy(month.alias("month"), "app").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        percent(one_star, F.count(F.lit(1)), 4).alias("one_star_pct"),
        round_even(F.avg("rating"), 4).alias("avg_rating"),
    )


def app_summary(df: DataFrame, signal: str = RESET_SIGNAL) -> DataFrame:
    """Per app: size, one-star share, mean rating and how often the signal is mentioned."""
    total = F.count(F.lit(1))
    hits = F.count_if(text.matches(F.col("review"), signal))
    return df.groupBy("app").agg(
        total.alias("n_reviews"),
        percent(F.count_if(F.col("rating") == 1), total).alias("one_star_pct"),
        round_even(F.avg("rating"), 2).alias("avg_rating"),
        hits.alias("signal_n"),
        percent(hits, total, 2).alias("signal_pct"),
    )


def rating_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("rating").agg(F.count(F.lit(1)).alias("n")).orderBy("rating")


def crawl_metrics(date: str, columns: tuple[str, ...] = ("seq", "review", "rating")) -> dict[str, Column]:
    """What the manifest of one crawl says, as aggregates to observe while the crawl is written."""
    return {
        "n_reviews": F.count(F.lit(1)),
        "first_date": F.min(date),
        "last_date": F.max(date),
        "rating_dist": snapshots.counts("rating", RATINGS),
        "content_hash": hashing.fingerprint_of(*map(F.col, columns)),
    }


def crawl_manifest(df: DataFrame, date: str, by: str = "app") -> DataFrame:
    """Rows, first and last date and the rating histogram of every crawl.

    The histogram is grouped first, so what is gathered per crawl is one entry per rating.
    """
    per_rating = df.groupBy(by, "rating").agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("lo"), F.max(date).alias("hi")
    )
    entry = F.concat_ws(":", F.coalesce(F.col("rating").cast("string"), F.lit("none")), "n")
    return per_rating.groupBy(by).agg(
        F.sum("n").alias("n_reviews"),
        F.min("lo").alias("first_date"),
        F.max("hi").alias("last_date"),
        F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("rating_dist"),
    )
