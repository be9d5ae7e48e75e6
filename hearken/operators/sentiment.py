"""Sentiment labels from ratings or from supplied model labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions.fixed_values import (
    LABEL_MAP,
    MODEL_METHOD,
    NEGATIVE_RATING,
    RATING_METHOD,
)
from hearken.functions.numeric import percent


def rating_sentiment(rating: Column) -> Column:
    """Low ratings are negative; a missing rating counts as positive."""
    return F.when(rating <= NEGATIVE_RATING, F.lit("neg")).otherwise(F.lit("pos"))


def label_by_rating(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"sentiment": rating_sentiment(F.col("rating")), "sentiment_method": F.lit(RATING_METHOD)}
    )


def mapped_label(label: Column, label_map: dict[str, str] = LABEL_MAP) -> Column:
    """Dictionary lookup as a literal map; unknown labels give NULL."""
    pairs = [F.lit(x) for item in label_map.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), label)


def label_by_model(
    df: DataFrame, label: str, label_map: dict[str, str] = LABEL_MAP
) -> DataFrame:
    """Use the model labels unless any of them is unknown; then the whole batch goes by rating."""
    known = F.coalesce(F.col(label).isin(list(label_map)), F.lit(False))
    trusted = df.agg(F.every(known)).scalar()
    chosen = F.when(trusted, mapped_label(F.col(label), label_map)).otherwise(
        rating_sentiment(F.col("rating"))
    )
    method = F.when(trusted, F.lit(MODEL_METHOD)).otherwise(F.lit(RATING_METHOD))
    return df.withColumns({"sentiment": chosen, "sentiment_method": method})


def negative_share(df: DataFrame) -> DataFrame:
    """Count and percentage of negative rows."""
    negative = F.count_if(F.col("sentiment") == "neg")
    return df.agg(
        F.count(F.lit(1)).alias("n_reviews"),
        negative.alias("n_negative"),
        percent(negative, F.count(F.lit(1))).alias("negative_pct"),
    )


def by_origin(df: DataFrame) -> DataFrame:
    return df.groupBy("origin", "sentiment").agg(F.count(F.lit(1)).alias("n"))


def rating_crosstab(df: DataFrame) -> DataFrame:
    """Rows per rating, one column per sentiment; rows without a rating are left out."""
    return (
        df.filter(F.col("rating").isNotNull())
        .groupBy("rating")
        .pivot("sentiment", ["neg", "pos"])
        .agg(F.count(F.lit(1)))
        .na.fill(0, ["neg", "pos"])
    )
