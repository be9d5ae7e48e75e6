"""Scoring predicted answer distributions against the answers seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.functions.fixed_values import SCORE_MIX, SCORE_WEIGHTS
from hearken.functions.numeric import round_even, to_number


def holdout_distribution(members: DataFrame, answer: str, segment: str = "segment") -> DataFrame:
    """Share of every rounded answer per segment, and how many answers were not whole.

    Segments and answers are few after the count, so the share is a window over a small table.
    """
    seen = members.filter(F.col(answer).isNotNull())
    value = F.rint(answer)
    counted = seen.groupBy(segment, value.cast("int").alias("category")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(value != F.col(answer)).alias("fractional_n"),
    )
    per_segment = Window.partitionBy(segment)
    return counted.withColumn(
        "share", round_even(F.col("n") / F.sum("n").over(per_segment), 4)
    )


def shares(df: DataFrame, by: str) -> DataFrame:
    """value_counts(normalize) of a column."""
    counted = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.withColumn("share_pct", round_even(F.col("n") / total * F.lit(100.0), 1))


def answer_cells(answer: str | Column) -> Column:
    """The members of the JSON object in a free-text answer, as text by name; NULL if there is none.

    The object is the span from the first to the last brace, or its `distribution` member.
    """
    span = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.from_json(F.coalesce(F.get_json_object(span, "$.distribution"), span), "map<string,string>")


def parsed_answers(df: DataFrame, answer: str, scale: tuple, out: str = "distribution") -> DataFrame:
    """The distribution a free-text answer contains, as a map over the scale that adds up to one.

    The JSON is the span from the first to the last brace, or its `distribution` member. Categories
    the answer leaves out are 0. No JSON, a null, a value that is no number, a negative value or no mass
    at all gives NULL.
    """
    cells = F.col("_cells")

    def share(category) -> Column:
        cell = F.try_element_at(cells, F.lit(str(category)))
        left_out = cells.isNotNull() & ~F.map_contains_key(cells, F.lit(str(category)))
        return F.when(left_out, F.lit(0.0)).otherwise(to_number(cell))

    values = F.col("_values")
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    sound = (F.array_size(F.array_compact(values)) == len(scale)) & (F.array_min(values) >= 0) & (total > 0)
    names = F.array(*[F.lit(str(c)) for c in scale])
    scaled = F.map_from_arrays(names, F.transform(values, lambda v: v / total))
    # one column per step, so that no answer is parsed twice
    return (
        df.withColumn("_cells", answer_cells(answer))
        .withColumn("_values", F.array(*[share(c) for c in scale]))
        .withColumn(out, F.when(F.coalesce(sound, F.lit(False)), scaled))
        .drop("_cells", "_values")
    )


def normalized(dist: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """Weights scaled to one per key; a key with a negative weight or no mass is invalid and dropped."""
    per_key = Window.partitionBy(*keys)
    total = F.sum(weight).over(per_key)
    lowest = F.min(weight).over(per_key)
    return (
        dist.withColumns({"_total": total, "_lowest": lowest})
        .filter((F.col("_lowest") >= 0) & (F.col("_total") > 0))
        .withColumn("p", F.col(weight) / F.col("_total"))
        .drop("_total", "_lowest")
    )


def aligned(predicted: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Both probabilities per key and category; a category one side lacks has probability 0."""
    both = predicted.join(observed, [*keys, "category"], "full_outer")
    zero = F.lit(0.0)
    return both.select(
        *keys, "category", F.coalesce("p", zero).alias("p"), F.coalesce("q", zero).alias("q")
    )


def total_variation(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Half the absolute difference; fidelity is one minus that."""
    distance = round_even(F.sum(F.abs(F.col("p") - F.col("q"))) * F.lit(0.5), 6)
    return pairs.groupBy(*keys).agg(distance.alias("tvd")).withColumn(
        "fidelity", round_even(F.lit(1.0) - F.col("tvd"), 4)
    )


def fidelity_summary(trials: DataFrame, by: str) -> DataFrame:
    """Mean and sample deviation over trials; one trial has no deviation, none has neither."""
    return trials.groupBy(by).agg(
        F.count("fidelity").alias("n_trials"),
        round_even(F.avg("fidelity"), 4).alias("mean"),
        round_even(F.stddev_samp("fidelity"), 4).alias("sd"),
    )


def scorecard(checks: DataFrame, agents: tuple[str, ...] = ("B", "E")) -> DataFrame:
    """Weighted score per run from (run_id, agent, item, passed); an item without checks is full.

    `checks` holds one row per checked unit, so the counts are aggregated before anything else.
    """
    rates = checks.groupBy("run_id", "agent", "item").agg(
        (F.count_if("passed") / F.count(F.lit(1))).alias("rate")
    )

    def points(agent: str) -> Column:
        total = F.lit(0.0)
        for item, weight in SCORE_WEIGHTS[agent].items():
            mine = (F.col("agent") == agent) & (F.col("item") == item)
            total = total + F.lit(weight) * F.coalesce(F.max(F.when(mine, F.col("rate"))), F.lit(1.0))
        return total

    per_run = rates.groupBy("run_id").agg(*[points(a).alias(f"score_{a.lower()}") for a in agents])
    mixed = sum((F.lit(SCORE_MIX[a]) * F.col(f"score_{a.lower()}") for a in agents), F.lit(0.0))
    total = mixed / F.lit(sum(SCORE_MIX[a] for a in agents))
    return per_run.select(
        "run_id",
        *[round_even(F.col(f"score_{a.lower()}"), 2).alias(f"score_{a.lower()}") for a in agents],
        round_even(total, 2).alias("score_total"),
    )
