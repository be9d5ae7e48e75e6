"""k-means for many numbers of clusters and restarts at once.

All models share the passes over the weighted patterns. Seeding follows k-means||: a few rounds, each one pass, draw patterns with
weights in proportion to their squared distance from those drawn before (the smallest exponential keys win, with keys from
a hash of the pattern, so no total is needed first and results repeat). The drawn patterns, weighted by the patterns nearest
to them, are few; every (k, seed) picks its first centres among them on the driver. Then each Lloyd step is one pass for all
models that still move: a task multiplies its patterns with all centres together and returns weighted sums, which are
added by partial aggregation. A last pass gives costs and silhouettes. So the number of passes is that of the slowest
model, not the sum over all of them.

What a pass returns has one row for each centre, and the drawn patterns are `rounds * draws` at most: both depend on the
models asked for, not on the rows. Rows with a NULL feature or weight, or a weight that is not positive, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 3
DRAWS = 5  # patterns drawn in a round for each cluster of the largest model
MOST_STEPS = 20
TOLERANCE = 1e-3


@dataclass
class Model:
    k: int
    seed: int
    centres: np.ndarray  # may hold fewer rows than k if patterns are few
    cost: float = 0.0
    sizes: np.ndarray | None = None
    silhouette: float = 0.0


def matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and their weights."""
    columns = [np.asarray(c, np.float64) for c in batch.columns]
    return np.stack(columns[:-1], axis=1), columns[-1]


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T, 0)


def usable(patterns: DataFrame, features: list[str], weight: str) -> DataFrame:
    cells = [F.col(c).cast("double").alias(c) for c in features]
    return patterns.select(*cells, F.col(weight).cast("double").alias("_weight")).dropna().filter("_weight > 0")


def drawn(rows: DataFrame, features: list[str], so_far: np.ndarray, n: int, turn: int) -> np.ndarray:
    """The n patterns with the smallest keys; keys are exponential with the rate weight * squared distance."""
    spot = (F.pmod(F.xxhash64(F.lit(turn), *features), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, weight = matrix(pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]))
            rate = weight * (squares(x, so_far).min(axis=1) if len(so_far) else 1.0)
            with np.errstate(divide="ignore"):
                key = -np.log(np.asarray(batch.columns[-1])) / rate
            best = np.argsort(key, kind="stable")[:n]
            best = best[rate[best] > 1e-12]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[best, i]) for i in range(x.shape[1])), pa.array(key[best])], [*features, "key"])

    schema = ", ".join(f"`{c}` double" for c in [*features, "key"])
    found = rows.withColumn("_spot", spot).mapInArrow(run, schema).orderBy("key", *features).limit(n).toArrow()
    return np.array([found.column(c).to_numpy() for c in features]).T.reshape(-1, len(features))


def summed(rows: DataFrame, features: list[str], models: list[Model]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """For every model: weights, sums, sums of squares by cluster, and the cost; one pass."""
    centres = np.concatenate([m.centres for m in models])
    bounds = np.cumsum([0] + [len(m.centres) for m in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), len(features) + 3))
        for batch in batches:
            x, weight = matrix(batch)
            far = squares(x, centres)
            wide = np.concatenate([np.ones((len(x), 1)), x, (x**2).sum(axis=1)[:, None]], axis=1) * weight[:, None]
            for low, high in zip(bounds, bounds[1:]):
                near = far[:, low:high].argmin(axis=1)
                pick = np.zeros((len(x), high - low))
                pick[np.arange(len(x)), near] = 1
                total[low:high, :-1] += pick.T @ wide
                total[low:high, -1] += np.bincount(near, weight * far[np.arange(len(x)), low + near], high - low)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres))), *map(pa.array, total.T)], names)

    names = ["at", "n", *[f"s{i}" for i in range(len(features))], "q", "cost"]
    schema = "at bigint, " + ", ".join(f"{c} double" for c in names[1:])
    found = rows.mapInArrow(run, schema).groupBy("at").agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow()
    table = np.zeros((len(centres), len(names) - 1))
    table[found.column("at").to_numpy()] = np.stack([found.column(c).to_numpy() for c in names[1:]], axis=1).reshape(-1, len(names) - 1)
    parts = [table[low:high] for low, high in zip(bounds, bounds[1:])]
    return {i: (p[:, 0], p[:, 1:-2], p[:, -2], float(p[:, -1].sum())) for i, p in enumerate(parts)}


def first_centres(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ on the drawn patterns, followed by a few steps among them."""
    rng = np.random.default_rng(seed)
    chosen = [points[rng.choice(len(points), p=weight / weight.sum())]]
    while len(chosen) < k:
        rate = weight * squares(points, np.array(chosen)).min(axis=1)
        if rate.sum() <= 1e-12:
            break
        chosen.append(points[rng.choice(len(points), p=rate / rate.sum())])
    centres = np.array(chosen)
    for _ in range(10):
        near = squares(points, centres).argmin(axis=1)
        for i in range(len(centres)):
            if weight[near == i].sum() > 0:
                centres[i] = np.average(points[near == i], axis=0, weights=weight[near == i])
    return centres


def fit(patterns: DataFrame, features: list[str], wanted: list[tuple[int, int]], weight: str = "weight") -> list[Model]:
    """A model for each (k, seed), fitted together."""
    rows = usable(patterns, features, weight)
    most = max(k for k, _ in wanted)
    pool = drawn(rows, features, np.zeros((0, len(features))), 1, 0)
    if not len(pool):
        raise ValueError("there are no patterns to cluster")
    for turn in range(1, ROUNDS + 1):
        pool = np.concatenate([pool, drawn(rows, features, pool, DRAWS * most, turn)])
    share = summed(rows, features, [Model(len(pool), 0, pool)])[0][0]
    models = [Model(k, seed, first_centres(pool[share > 0], share[share > 0], k, seed)) for k, seed in wanted]
    moving = models
    for _ in range(MOST_STEPS):
        sums = summed(rows, features, moving)
        still = []
        for i, model in enumerate(moving):
            n, total, _, model.cost = sums[i]
            model.sizes = n
            means = np.where(n[:, None] > 0, total / np.maximum(n, 1e-300)[:, None], model.centres)
            moved = float(np.sqrt(((means - model.centres) ** 2).sum(axis=1)).max())
            model.centres = means
            if moved > TOLERANCE:
                still.append(model)
        moving = still
        if not moving:
            break
    return models


def judged(patterns: DataFrame, features: list[str], models: list[Model], weight: str = "weight") -> list[Model]:
    """The models with sizes, costs and silhouettes (squared Euclidean, by weight) under their final centres, in two passes."""
    rows = usable(patterns, features, weight)
    sums = summed(rows, features, models)
    for i, model in enumerate(models):
        model.sizes, model.cost = sums[i][0], sums[i][3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), 2))
        for batch in batches:
            x, w = matrix(batch)
            norm = (x**2).sum(axis=1)[:, None]
            for i, model in enumerate(models):
                n, s, q, _ = sums[i]
                used = np.flatnonzero(n > 0)
                total[i, 1] += w.sum()
                if len(used) < 2:
                    continue
                own = np.searchsorted(used, squares(x, model.centres).argmin(axis=1))
                apart = norm * n[used] + q[used] - 2 * x @ s[used].T
                at = np.arange(len(x))
                size = n[used][own]
                near = np.where(size > 1, apart[at, own] / np.maximum(size - 1, 1e-300), 0)
                mean = apart / n[used]
                mean[at, own] = np.inf
                far = mean.min(axis=1)
                top = np.maximum(near, far)
                total[i, 0] += (w * np.where((size > 1) & (top > 0), (far - near) / np.where(top > 0, top, 1), 0)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models))), pa.array(total[:, 0]), pa.array(total[:, 1])], ["at", "s", "w"])

    found = rows.mapInArrow(run, "at bigint, s double, w double").groupBy("at").agg((F.sum("s") / F.sum("w")).alias("v")).collect()
    for row in found:
        models[row["at"]].silhouette = row["v"]
    return models


def nearest(features: list[str], centres: np.ndarray) -> Column:
    """(distance, cluster) of the nearest centre, found for a batch of rows at once; the smaller number on ties.

    As one expression over all features and centres it would be too long a method for the JVM to compile.
    """

    @F.pandas_udf("distance double, cluster int")
    def found(*columns: pd.Series) -> pd.DataFrame:
        far = np.zeros((len(columns[0]), len(centres)))
        for column, at in zip(columns, centres.T):
            apart = column.to_numpy(float)[:, None] - at
            far += apart * apart
        near = far.argmin(axis=1)
        return pd.DataFrame({"distance": far[np.arange(len(far)), near], "cluster": near.astype("int32")})

    return found(*[F.col(c).cast("double") for c in features])
