"""Connected components by alternating large-star and small-star steps.

Both steps are a minimum per node (partial aggregation) and one join, so a node with very many links is spread by Spark's
skew handling; nothing is gathered per node or on the driver. Every round is written to the shared folder, which cuts
the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.session import materialize

MAX_ROUNDS = 60


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (a, b) with a < b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    large = both.join(least, "a").filter("b > a").select(F.col("low").alias("a"), "b")
    large = large.filter("a < b").distinct()
    least = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("low"))
    tied = large.join(least, large["b"] == least["n"])
    small = tied.select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return small.filter("a < b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def star_forest(edges: DataFrame) -> DataFrame:
    """(a, b): every node b but the smallest of its component, with that smallest node a."""
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    seen = _state(now)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            return now
        now = materialize(_round(now), "edges")
        before, seen = seen, _state(now)
        if before == seen:
            return now
    raise RuntimeError("components did not settle")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`nodes` (id, first) with `first` replaced by the smallest `first` of the node's component."""
    stars = star_forest(edges)
    linked = nodes.join(stars.select(F.col("b").alias("id"), F.col("a").alias("root")), "id", "left")
    linked = linked.withColumn("root", F.coalesce("root", "id"))
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    return linked.join(least, "root").select("id", F.col("least").alias("first"))
