"""Respondent segments: imputation, standardisation, k-means, profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.functions import hashing
from hearken.functions.fixed_values import (
    MIN_RESPONDENTS,
    QUOTES_PER_SEGMENT,
    SEGMENT_K_MAX,
    SEGMENT_RESTARTS,
    SEGMENT_SEED,
)
from hearken.functions.numeric import round_even
from hearken.operators import kmeans
from hearken.operators.cleaning import top_per_key
from hearken.operators.ordered import exact_medians
from hearken.sources import snapshots


def impute_median(df: DataFrame, features: list[str]) -> DataFrame:
    """Fill NULL with the exact median of the column, which a scalar subquery finds when the plan runs."""
    pairs = exact_medians(df, features).agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))))
    told = df.withColumn("_medians", pairs.scalar())  # one entry a column
    filled = {c: F.coalesce(F.col(c).cast("double"), F.try_element_at("_medians", F.lit(c))) for c in features}
    return told.withColumns(filled).drop("_medians")


def standardize(df: DataFrame, features: list[str], suffix: str = "_z") -> DataFrame:
    """z-scores with the population deviation; a constant column becomes 0."""
    moments = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in features])
    told = df.withColumn("_moments", moments.select(F.struct("*")).scalar())

    def z(c: str) -> Column:
        mean, deviation = F.col(f"_moments.`{c}`.m"), F.col(f"_moments.`{c}`.s")
        return F.when(deviation > 0, (F.col(c) - mean) / F.nullif(deviation, F.lit(0.0))).otherwise(F.col(c) * F.lit(0.0))

    return told.withColumns({f"{c}{suffix}": z(c) for c in features}).drop("_moments")


def distinct_vectors(df: DataFrame, features: list[str]) -> DataFrame:
    """The distinct answer patterns with their counts.

    Coded answers repeat a lot, so k-means on weighted patterns gives the result of k-means on all
    rows over far fewer vectors.
    """
    return df.groupBy(*features).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def best_kmeans(
    patterns: DataFrame, features: list[str], k: int, restarts: int = SEGMENT_RESTARTS, seed: int = SEGMENT_SEED
) -> kmeans.Model:
    """The restart of the lowest cost; all restarts share their passes."""
    models = kmeans.fit(patterns, features, [(k, seed + i) for i in range(restarts)])
    return min(kmeans.judged(patterns, features, models), key=lambda m: m.cost)


@dataclass
class Choice:
    k: int
    silhouette: float
    model: kmeans.Model
    models: list[kmeans.Model]  # the best one of every k

    @property
    def elbow(self) -> list[tuple[int, float, float]]:
        """(k, cost, silhouette)"""
        return [(m.k, m.cost, m.silhouette) for m in self.models]


def choose_k(
    patterns: DataFrame,
    features: list[str],
    k_max: int = SEGMENT_K_MAX,
    restarts: int = SEGMENT_RESTARTS,
    seed: int = SEGMENT_SEED,
) -> Choice:
    """Fit k = 2..k_max and keep the highest silhouette, the smallest k on ties.

    All numbers of segments and all restarts are fitted together. The silhouette is the squared-Euclidean one, linear in the
    rows; the plain Euclidean one needs all pairs.
    """
    size = patterns.agg(F.count(F.lit(1)).alias("distinct"), F.sum("weight").alias("rows")).first()
    if size["distinct"] < 2:
        raise ValueError("fewer than two distinct answer patterns cannot be clustered")
    if size["rows"] < MIN_RESPONDENTS:
        raise ValueError(f"{size['rows']:.0f} respondents, at least {MIN_RESPONDENTS} are needed")
    top = int(min(k_max, size["rows"] - 1, size["distinct"]))
    models = kmeans.fit(patterns, features, [(k, seed + i) for k in range(2, top + 1) for i in range(restarts)])
    best = [min((m for m in models if m.k == k), key=lambda m: m.cost) for k in range(2, top + 1)]
    usable = [m for m in kmeans.judged(patterns, features, best) if 2 <= (m.sizes > 0).sum() < size["rows"]]
    if not usable:
        raise ValueError("no usable number of segments")
    chosen = max(usable, key=lambda m: (m.silhouette, -m.k))
    return Choice(chosen.k, chosen.silhouette, chosen, usable)


def assign(df: DataFrame, model: kmeans.Model, features: list[str]) -> DataFrame:
    """Segment of every respondent, numbered by size (largest first), then by centre.

    k-means labels are arbitrary; this numbering depends on the result only.
    """
    order = sorted(range(len(model.centres)), key=lambda i: (-model.sizes[i], model.centres[i].tolist()))
    return df.withColumn("segment", kmeans.nearest(features, model.centres[order])["cluster"])


def pca_2d(df: DataFrame, features: list[str]) -> DataFrame:
    """Two principal components of standardised features, signs fixed by the largest loading."""
    vectors = VectorAssembler(inputCols=features, outputCol="x").transform(df)
    model = PCA(k=2, inputCol="x", outputCol="pc").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if max(col, key=abs) >= 0 else -1.0 for col in loadings.T]
    both = vector_to_array("pc")
    return (
        model.transform(vectors)
        .withColumns({f"pc{i + 1}": both[i] * F.lit(signs[i]) for i in range(2)})
        .drop("x", "pc")
    )


def profile(df: DataFrame, features: list[str], source_type: str = "survey") -> DataFrame:
    """Feature means and share per segment, stamped with the data source."""
    counted = df.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), *[round_even(F.avg(c), 2).alias(c) for c in features]
    )
    # one row per segment
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counted.withColumns(
        {"share_pct": round_even(share * F.lit(100.0), 1), "source_type": F.lit(source_type)}
    )


def sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def quotes(df: DataFrame, quote: str = "quote", order: str = "respondent_id") -> DataFrame:
    """The first non-blank quotes of every segment, trimmed."""
    said = df.withColumn(quote, F.trim(quote)).filter(F.length(quote) > 0)
    return top_per_key(said, ["segment"], [order], QUOTES_PER_SEGMENT).select("segment", order, quote)


def manifest(df: DataFrame, features: list[str]) -> DataFrame:
    """Respondents, imputed cells, segments and the sizes of the segments in one row."""
    cells = sum((F.count_if(F.col(c).isNull()) for c in features), F.lit(0))
    per_segment = df.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), cells.alias("missing"))
    entry = F.concat_ws(":", "segment", "n")
    return per_segment.agg(
        F.sum("n").alias("n_respondents"),
        F.sum("missing").alias("n_imputed_cells"),
        F.count(F.lit(1)).alias("k"),
        F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("segment_sizes"),
    )


def silhouette(df: DataFrame, features: list[str], segment: str = "segment") -> DataFrame:
    """(silhouette) on squared Euclidean distances, in two passes and without pairs.

    The mean distance of a row to a segment follows from the segment's count, sums and sum of squares, of which there is one
    row a segment. Rows of segments with one member count 0, as do all rows if there is one segment.
    """
    squares = sum((F.col(c) * F.col(c) for c in features), F.lit(0.0))
    per_segment = df.groupBy(F.col(segment).alias("s")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(squares).alias("q"), *[F.sum(c).alias(f"m{i}") for i, c in enumerate(features)]
    )
    all_of_them = per_segment.agg(F.collect_list(F.struct("*"))).scalar()

    def distance(o: Column) -> Column:
        dot = sum((F.col(c) * o[f"m{i}"] for i, c in enumerate(features)), F.lit(0.0))
        return squares * o["n"] + o["q"] - F.lit(2.0) * dot

    # the distances to all segments are found once a row; what follows only picks among them
    told = df.withColumn("_all", all_of_them)
    apart = F.transform("_all", lambda o: F.struct((o["s"] == F.col(segment)).alias("own"), o["n"].alias("n"), distance(o).alias("sum")))
    told = told.select(apart.alias("_apart"))
    own = F.filter("_apart", lambda o: o["own"])[0]
    far = F.array_min(F.transform(F.filter("_apart", lambda o: ~o["own"]), lambda o: o["sum"] / o["n"]))
    told = told.select(own.alias("_own"), far.alias("_far"))
    near = F.when(F.col("_own.n") > 1, F.col("_own.sum") / (F.col("_own.n") - 1))
    told = told.select("_far", near.alias("_near"))
    width = F.coalesce((F.col("_far") - F.col("_near")) / F.nullif(F.greatest("_far", "_near"), F.lit(0.0)), F.lit(0.0))
    return told.select(width.alias("_w")).agg(F.avg("_w").alias("silhouette"))


def publish_outputs(df: DataFrame, z: DataFrame, features: list[str], path: str, run_id: str, source_type: str) -> dict:
    """Publishes members, profile and z-profile, and gives the manifest of the run, hashes from the passes that write.

    `df` has respondent_id, segment and features (NULL where they were missing), `z` besides the filled features and their
    z-scores (`_z`). Means are hashed as whole hundredths, as they are shown.
    """
    scores = [f"{c}_z" for c in features]

    def shown(names: list[str]) -> Column:
        return hashing.fingerprint_of(F.col("segment"), F.col("n"), *[F.rint(F.col(c) * 100).cast("bigint") for c in names])

    told = snapshots.observed(df.select("respondent_id", "segment", *features), f"{path}/members", run_id, {
        "n_respondents": F.count(F.lit(1)),
        "n_imputed_cells": sum((F.count_if(F.col(c).isNull()) for c in features), F.lit(0)),
        "seg_members_hash": hashing.fingerprint_of(F.col("respondent_id"), F.col("segment")),
    })
    told |= snapshots.observed(profile(z, features, source_type), f"{path}/profile", run_id, {
        "k": F.count(F.lit(1)),
        "segment_sizes": F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "segment", "n"))), ","),
        "seg_profile_hash": shown(features),
    })
    told |= snapshots.observed(profile(z, scores, source_type), f"{path}/zprofile", run_id, {"seg_zprofile_hash": shown(scores)})
    width = silhouette(z, scores).select(round_even(F.col("silhouette"), 4)).first()[0]
    return {**told, "silhouette": width, "source_type": source_type}
