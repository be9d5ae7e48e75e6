"""Importing this module registers every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearken.plans import (  # noqa: F401
    commands,
    homes,
    landed,
    models,
    quality,
    reviews,
    surveys,
    voices,
)
from hearken.plans.registry import ORACLES, QUERIES, Inputs

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.ranked_pain_points(Inputs(spark, sf_dir))
