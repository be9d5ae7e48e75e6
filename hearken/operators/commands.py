"""Device commands: validation, change events, current state, replay guard, frame reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions.fixed_values import (
    CAPABILITIES,
    CHOICES,
    COMMAND_BUDGET,
    MAX_FRAMES,
    RANGES,
    SWITCHES,
)
from hearken.operators import scans


def item_error(capability: Column, value: Column, value_type: Column) -> Column:
    """Why one item of a command is invalid, else NULL."""
    number = F.when(value_type == "integer", value.try_cast("bigint"))
    error = F.when(
        ~F.coalesce(capability.isin(list(CAPABILITIES)), F.lit(False)), "unknown_capability"
    )
    error = error.when(
        capability.isin(list(SWITCHES)), F.when(~value_type.eqNullSafe("boolean"), "not_boolean")
    )
    for name, allowed in CHOICES.items():
        bad = F.when(~value_type.eqNullSafe("string"), "not_string").when(
            ~F.coalesce(value.isin(list(allowed)), F.lit(False)), "not_a_choice"
        )
        error = error.when(capability == name, bad)
    for name, (low, high) in RANGES.items():
        bad = F.when(number.isNull(), "not_integer").when(~number.between(low, high), "out_of_range")
        error = error.when(capability == name, bad)
    return error.otherwise(F.lit("no_rule"))


def judged_commands(items: DataFrame) -> DataFrame:
    """Per command: accepted only if every item is valid."""
    checked = items.withColumn(
        "error", item_error(F.col("capability"), F.col("value"), F.col("value_type"))
    )
    return checked.groupBy("command_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count("error").alias("n_errors"),
        F.every(F.col("error").isNull()).alias("accepted"),
    )


def change_events(commands: DataFrame, parts: int | None = None) -> DataFrame:
    """Commands that change a value: old and new value, numbered per device.

    A prefix scan over (device, ts, seq), see `scans`: a device that sends any share of all commands, in whatever burst,
    is spread over as many tasks as its rows fill.
    """
    return scans.change_events(commands, parts)


def latest_state(commands: DataFrame) -> DataFrame:
    """The current value of every capability of every device."""
    newest = F.max_by("value", F.struct("ts", "seq"))
    return commands.groupBy("device", "capability").agg(newest.alias("value"))


def replay_guard(events: DataFrame, parts: int | None = None) -> DataFrame:
    """Outcome of every attempt against the one live challenge of its device.

    Input rows are `issue` or `attempt` with a nonce. An issue replaces the live challenge; the
    first matching attempt closes it. Later attempts find no challenge until the next issue.
    A prefix scan over (device, ts, seq), see `scans`.
    """
    return scans.replay_guard(events, parts)


def reassemble(frames: DataFrame) -> DataFrame:
    """Messages from frames (msg_id, seq_no, total, payload), or the reason to reject them.

    Frames are first grouped per message and sequence number, with all out-of-range numbers in one
    group. A message therefore contributes at most MAX_FRAMES + 1 rows to the second grouping,
    however many frames were sent in its name, and nothing unbounded is gathered.
    """
    slot = F.when(F.col("seq_no").between(0, MAX_FRAMES - 1), F.col("seq_no")).otherwise(F.lit(-1))
    per_slot = frames.groupBy("msg_id", slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("total").alias("low"),
        F.max("total").alias("high"),
        F.count("total").alias("n_total"),
        F.first("payload").alias("payload"),
    )
    part = F.struct(F.col("slot").alias("slot"), F.col("payload").alias("payload"))
    seen = per_slot.groupBy("msg_id").agg(
        F.sum("n").alias("n_frames"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("n_total").alias("n_total"),
        F.max("n").alias("most"),
        F.min("slot").alias("first_slot"),
        F.max("slot").alias("last_slot"),
        F.count(F.lit(1)).alias("n_slots"),
        F.array_sort(F.collect_list(part)).alias("parts"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["payload"]), "")
    reason = (
        F.when(F.col("n_frames") > MAX_FRAMES, "too_many_frames")
        .when((F.col("n_total") < F.col("n_frames")) | (F.col("low") < 1), "total_invalid")
        .when(F.col("low") != F.col("high"), "totals_differ")
        .when(F.col("low") != F.col("n_frames"), "total_not_received")
        .when((F.col("first_slot") < 0) | (F.col("last_slot") >= F.col("low")), "seq_out_of_range")
        .when(F.col("most") > 1, "seq_repeated")
        .when(F.col("n_slots") != F.col("low"), "seq_missing")
        .when(F.octet_length(text) > COMMAND_BUDGET, "too_large")
        .otherwise("complete")
    )
    return seen.select(
        "msg_id", "n_frames", reason.alias("outcome"), F.when(reason == "complete", text).alias("message")
    )
