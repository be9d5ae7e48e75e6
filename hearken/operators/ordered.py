"""Order-dependent work on groups of any size.

A window over a key runs in one task, so a key that holds a large share of the rows would stall
the job. The helpers here cut every key into buckets of the ordering column, work inside the
buckets, and pass a small per-bucket summary from one bucket to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
MEDIAN_BINS = 65536
SKETCH_SIZE = 2048
SKETCH_SLACK = 0.01  # ranks on either side of the middle; the sketch is off by some 0.2 %


def time_bucket(ts: str, width: str = "1 hour") -> Column:
    """The start of the slot a timestamp falls in."""
    return F.window(F.col(ts).cast("timestamp"), width)["start"]


def carried(
    df: DataFrame,
    keys: list[str],
    states: dict[str, tuple[Column, Callable[[Column], Column]]],
    bucket: str = BUCKET,
) -> DataFrame:
    """Attach to every row what the earlier buckets of its key add up to.

    `states` maps a column name to (aggregate over one bucket, combination over buckets). The
    window over buckets sees one row per key and bucket; the join and any later window over
    (keys, bucket) share one partitioning.
    """
    per_bucket = df.groupBy(*keys, bucket).agg(*[agg.alias(n) for n, (agg, _) in states.items()])
    earlier = (
        Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    combined = [combine(F.col(n)).over(earlier).alias(n) for n, (_, combine) in states.items()]
    return df.join(per_bucket.select(*keys, bucket, *combined), [*keys, bucket])


def last_known(column: Column) -> Column:
    return F.last(column, ignorenulls=True)


def inside(keys: list[str], order: list[str], bucket: str = BUCKET):
    return Window.partitionBy(*keys, bucket).orderBy(*order)


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, bucket: str = BUCKET
) -> DataFrame:
    """The previous value of the key in the given order; values must not be NULL."""
    newest = F.max_by(value, F.struct(*order))
    joined = carried(df, keys, {"_carry": (newest, last_known)}, bucket)
    here = F.lag(value).over(inside(keys, order, bucket))
    return joined.withColumn(out, F.coalesce(here, F.col("_carry"))).drop("_carry")


def with_position(
    df: DataFrame, keys: list[str], order: list[str], out: str, bucket: str = BUCKET
) -> DataFrame:
    """1, 2, 3 ... per key in the given order."""
    joined = carried(df, keys, {"_carry": (F.count(F.lit(1)), F.sum)}, bucket)
    here = F.row_number().over(inside(keys, order, bucket))
    position = (here + F.coalesce(F.col("_carry"), F.lit(0))).cast("bigint")
    return joined.withColumn(out, position).drop("_carry")


def exact_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, median) of every column, exact at any size; columns without a value have no row.

    One pass sketches all columns at once (KLL quantiles and counts). They bound a narrow range around the middle, which
    is cut into bins, with one more bin below and one above it, so far values cannot crowd the others into one bin. The
    second pass counts by bin, and the totals point to the bin or two that hold the middle ranks; the third reads only the
    values of those. Nothing but counts is shuffled before that. The result is exact whatever the sketch gave.
    """
    numbered = list(enumerate(columns))
    seen = df.agg(
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(SKETCH_SIZE)).alias(f"s{i}") for i, c in numbered],
        *[F.count(c).alias(f"n{i}") for i, c in numbered],
    )

    def quantile(i: int, rank: float) -> Column:
        return F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(F.col(f"s{i}"), F.lit(rank)))

    spans = seen.select(
        F.array(*[
            F.struct(quantile(i, 0.5 - SKETCH_SLACK).alias("lo"), quantile(i, 0.5 + SKETCH_SLACK).alias("hi"), F.col(f"n{i}").alias("total"))
            for i, _ in numbered
        ])
    ).scalar()
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in numbered])
    long = df.select(F.explode(cells).alias("cell")).select("cell.*").filter("value is not null").withColumn("span", spans[F.col("i")])
    value, lo, hi = F.col("value"), F.col("span.lo"), F.col("span.hi")
    place = (
        F.when(value < lo, F.lit(-1))
        .when(value > hi, F.lit(MEDIAN_BINS + 1))
        .when(hi > lo, F.floor((value - lo) / (hi - lo) * MEDIAN_BINS))
        .otherwise(F.lit(0))
    )
    binned = long.select("feature", "value", place.cast("bigint").alias("bin"), F.col("span.total").alias("total"))
    totals = binned.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("bin_n"), F.first("total").alias("total"))
    ends = totals.withColumn("upto", F.sum("bin_n").over(Window.partitionBy("feature").orderBy("bin")))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    before = F.col("upto") - F.col("bin_n")
    middle = ends.filter(((before < low) & (low <= F.col("upto"))) | ((before < high) & (high <= F.col("upto"))))
    # at most two bins a column
    held = middle.agg(F.collect_list(F.struct("feature", "bin", before.alias("before")))).scalar()
    mine = F.get(F.filter("_held", lambda h: (h["feature"] == F.col("feature")) & (h["bin"] == F.col("bin"))), F.lit(0))
    few = binned.withColumn("_held", held).withColumn("before", mine["before"]).filter("before is not null")
    counted = few.groupBy("feature", "bin", "before", "total", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.col("before") + F.sum("n").over(Window.partitionBy("feature", "bin").orderBy("value"))
    ranked = counted.withColumn("last_rank", rank).withColumn("first_rank", rank - F.col("n") + 1)
    hit_low = (F.col("first_rank") <= low) & (low <= F.col("last_rank"))
    hit_high = (F.col("first_rank") <= high) & (high <= F.col("last_rank"))
    return ranked.groupBy("feature").agg(
        ((F.max(F.when(hit_low, F.col("value"))) + F.max(F.when(hit_high, F.col("value")))) / 2).alias("median")
    )
