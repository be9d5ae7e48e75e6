"""Search hits by theme (axis): noise removal, yield, validity, testimonies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions import hashing, text
from hearken.functions.fixed_values import (
    APP_MENTION,
    AXIS_SIGNAL,
    AXIS_YIELD_THRESHOLD,
    DEVICE_NOISE,
    EXPERIENCE,
    GUIDE_TONE,
    OFF_TOPIC,
    SPONSORED,
)
from hearken.functions.numeric import percent
from hearken.operators.cleaning import first_per_key, top_per_key


def axis_hit(review: Column, axis: Column, signals: dict[str, str] = AXIS_SIGNAL) -> Column:
    """Does the text match the pattern of its own axis?

    One branch per axis keeps every pattern a literal that is compiled once, where a join on the
    axis would hand the regex engine a changing pattern.
    """
    hit = F.lit(False)
    for name, pattern in signals.items():
        hit = F.when(axis == name, text.matches(review, pattern)).otherwise(hit)
    return hit


def with_flags(
    df: DataFrame,
    signals: dict[str, str] = AXIS_SIGNAL,
    app_mention: str = APP_MENTION,
    off_topic: str = OFF_TOPIC,
) -> DataFrame:
    review = F.col("review")
    flagged = df.withColumns(
        {
            "axis_hit": axis_hit(review, F.col("axis"), signals),
            "app_mention": text.matches(review, app_mention),
            "off_topic": text.matches(review, off_topic),
        }
    )
    return flagged.withColumn("valid", F.expr("axis_hit AND app_mention AND NOT off_topic"))


def axis_yield(flagged: DataFrame, axes: list[str], threshold: float = AXIS_YIELD_THRESHOLD) -> DataFrame:
    """Per known axis: hits of every kind, valid share and verdict (on the unrounded share)."""
    total, valid = F.count(F.lit(1)), F.count_if("valid")
    adopted = valid.cast("double") / total * F.lit(100.0) >= F.lit(threshold)
    return (
        flagged.filter(F.col("axis").isin(axes))
        .groupBy("axis")
        .agg(
            total.alias("collected"),
            F.count_if("axis_hit").alias("signal_n"),
            F.count_if("app_mention").alias("app_n"),
            F.count_if("off_topic").alias("off_topic_n"),
            valid.alias("valid_n"),
            percent(valid, total).alias("valid_pct"),
            F.when(adopted, "adopt").otherwise("redesign").alias("verdict"),
        )
    )


def without_device_noise(df: DataFrame, pattern: str = DEVICE_NOISE) -> DataFrame:
    return df.filter(~text.matches(F.col("review"), pattern))


def collect_hits(
    raw: DataFrame, per_query: int | None = None, sponsored: str = SPONSORED, noise: str = DEVICE_NOISE
) -> DataFrame:
    """Landed hits to the hit table: flag, first per link, drop noise; a cap per query and source only if asked for."""
    capped = raw if per_query is None else top_per_key(raw, ["query", "origin"], ["seq"], per_query)
    flagged = capped.withColumn("sponsored", text.matches(F.col("review"), sponsored))
    return without_device_noise(first_per_key(flagged, ["link"], ["seq"]), noise)


def manifest(hits: DataFrame) -> DataFrame:
    """Rows and sponsored rows per source."""
    return hits.groupBy("origin").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("sponsored").alias("sponsored_rows")
    )


def search_metrics(axes: list[str], threshold: float = AXIS_YIELD_THRESHOLD) -> dict[str, Column]:
    """What the manifest of a search says, as aggregates to observe while the flagged hits are written.

    `axis_yield` has `axis:collected:valid` for every known axis that occurs, `adopted` the axes at or over the threshold.
    """
    told, adopted = [], []
    for axis in axes:
        total, valid = F.count_if(F.col("axis") == axis), F.count_if((F.col("axis") == axis) & F.col("valid"))
        told.append(F.when(total > 0, F.concat_ws(":", F.lit(axis), total.cast("string"), valid.cast("string"))))
        share = valid.cast("double") / F.nullif(total, F.lit(0)) * F.lit(100.0)
        adopted.append(F.when(share >= threshold, F.lit(axis)))
    return {
        "n_rows": F.count(F.lit(1)),
        "sponsored_rows": F.count_if("sponsored"),
        "axis_yield": F.concat_ws(",", *told),
        "adopted": F.concat_ws(",", *adopted),
        "content_hash": hashing.fingerprint_of(F.col("seq"), F.col("review"), F.col("axis")),
    }


def with_tone(valid: DataFrame, experience: str = EXPERIENCE, guide: str = GUIDE_TONE) -> DataFrame:
    return valid.withColumns(
        {
            "experience": text.matches(F.col("review"), experience),
            "guide_tone": text.matches(F.col("review"), guide),
        }
    )


def testimonies(toned: DataFrame) -> DataFrame:
    """First-person reports first, how-to texts and sponsored posts last, then input order."""
    return toned.orderBy(F.desc("experience"), "guide_tone", "sponsored", "seq")
