"""Topics of negative reviews turned into ranked pain points, and the strengths beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hearken.functions.fixed_values import NOISE_TOPIC, QUOTE_LENGTH, STRENGTH_ROWS
from hearken.functions.numeric import percent, round_even


def whole_report() -> WindowSpec:
    """A frame over a finished report, which has one row per topic."""
    return Window.partitionBy(F.lit(1))


def topic_counts(negatives: DataFrame, topic: str = "topic") -> DataFrame:
    """One row per topic, noise included: count and mean rating."""
    return negatives.groupBy(topic).agg(
        F.count(F.lit(1)).alias("freq"),
        round_even(F.avg("rating"), 2).alias("avg_rating"),
    )


def assigned_only(df: DataFrame, topic: str = "topic") -> DataFrame:
    return df.filter(F.col(topic) != NOISE_TOPIC)


def with_mentions(counts: DataFrame, topic: str = "topic") -> DataFrame:
    """Mention shares against all negatives and against the assigned ones.

    Both totals are windows over the topic table, which a topic model keeps to a few rows, so the
    reviews behind it are read once.
    """
    assigned_freq = F.when(F.col(topic) != NOISE_TOPIC, F.col("freq"))
    shares = counts.withColumns(
        {
            "mention_all_pct": percent(F.col("freq"), F.sum("freq").over(whole_report())),
            "mention_assigned_pct": percent(F.col("freq"), F.sum(assigned_freq).over(whole_report())),
        }
    )
    return assigned_only(shares, topic)


def noise_rate(counts: DataFrame, topic: str = "topic") -> DataFrame:
    noise = F.coalesce(F.sum(F.when(F.col(topic) == NOISE_TOPIC, F.col("freq"))), F.lit(0))
    return counts.agg(
        F.sum("freq").alias("negative_count"),
        noise.alias("noise_count"),
        percent(noise, F.sum("freq")).alias("noise_pct"),
    )


def representative(
    assigned: DataFrame, topic: str = "topic", weight: str = "topic_prob"
) -> DataFrame:
    """Per topic the assigned document of the highest weight, the earliest on ties.

    The winners are found on narrow rows; the texts are fetched only for them.
    """
    best = F.max_by("seq", F.struct(F.col(weight), -F.col("seq")))
    winners = assigned.groupBy(topic).agg(best.alias("seq"))
    return winners.join(assigned.select("seq", F.col("review").alias("rep_review")), "seq")


def with_quotes(
    points: DataFrame, quotes: DataFrame, topic: str = "topic", length: int | None = QUOTE_LENGTH
) -> DataFrame:
    """Attach the representative text, cut to report length (whole without one); topics without a text get ''."""
    quote = F.coalesce(F.col("rep_review"), F.lit(""))
    quote = quote if length is None else F.substring(quote, 1, length)
    return points.join(quotes.select(topic, "rep_review"), topic, "left").withColumn(
        "rep_review", quote
    )


def pain_points(
    negatives: DataFrame, topic: str = "topic", weight: str = "topic_prob", length: int | None = QUOTE_LENGTH
) -> DataFrame:
    """The six-column pain-point table in one aggregation.

    Only the first `length` characters of a text can reach the report, so the aggregation carries those and
    not whole reviews; with None it carries the texts.
    """
    quote = F.col("review") if length is None else F.substring("review", 1, length)
    best = F.max_by(quote, F.struct(F.col(weight), -F.col("seq")))
    counts = negatives.groupBy(topic).agg(
        F.count(F.lit(1)).alias("freq"),
        round_even(F.avg("rating"), 2).alias("avg_rating"),
        F.coalesce(best, F.lit("")).alias("rep_review"),
    )
    return with_mentions(counts, topic)


def strengths(labelled: DataFrame, n: int = STRENGTH_ROWS) -> DataFrame:
    """The best positive reviews by rating and likes; unrated ones come last."""
    return (
        labelled.filter(F.col("sentiment") == "pos")
        .orderBy(F.desc_nulls_last("rating"), F.desc_nulls_last("likes"), "seq")
        .limit(n)
        .select("seq", "review", "rating", "likes")
    )


def severity(avg_rating: Column) -> Column:
    return round_even(F.lit(5.0) - avg_rating, 2)


def with_priority(points: DataFrame) -> DataFrame:
    """Severity, heuristic score, bubble size and quadrant of every pain point."""
    scored = points.withColumn("severity", severity(F.col("avg_rating")))
    often = F.col("mention_all_pct") >= F.median("mention_all_pct").over(whole_report())
    severe = F.col("severity") >= F.median("severity").over(whole_report())
    quadrant = (
        F.when(often & severe, "first")
        .when(severe, "severe_rare")
        .when(often, "mild_frequent")
        .otherwise("low")
    )
    return scored.withColumns(
        {
            "priority_score": round_even(F.col("mention_all_pct") * F.col("severity"), 1),
            "bubble_size": F.lit(100.0)
            + F.lit(500.0) * (F.col("freq") / F.max("freq").over(whole_report())),
            "quadrant": quadrant,
        }
    )
