"""Audits over fleets of home profiles held as long tables.

devices(home_id, pos, device_ref, device_type, capabilities array)
settings(home_id, device_ref, setting_key, value)
actions(home_id, routine_id, line_no, part_no, supp_no, device_ref, setting_key, value)

Counts come from partial aggregation. Lists are only ever built for homes whose counts are within
the limits of a profile, so no group that is collected can grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions import privacy
from hearken.functions.fixed_values import (
    KEY_SHAPE,
    MAX_ACTIONS,
    MAX_CAPABILITIES,
    MAX_DEVICES,
    MAX_ROUTINES,
    MAX_SETTING_LENGTH,
    MAX_SETTINGS,
    TOKEN_SHAPE,
)

ACTION_ORDER = ("line_no", "part_no", "supp_no", "value")


def rule_rows(df: DataFrame, rules: dict[str, Column], item: str) -> DataFrame:
    """(home_id, rule, item) for every broken rule; items are positions and refs, not values."""
    hits = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items()])
    )
    return df.select("home_id", F.col(item).cast("string").alias("item"), F.explode(hits).alias("rule"))


def misshapen(cell: Column, shape: str) -> Column:
    return ~F.coalesce(cell.rlike(shape), F.lit(False))


def over(df: DataFrame, keys: list[str], limit: int, rule: str) -> DataFrame:
    """Groups with more rows than a limit."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    item = keys[-1] if len(keys) > 1 else "home_id"
    return counted.select("home_id", F.col(item).cast("string").alias("item"), F.lit(rule).alias("rule"))


def ghosts(rows: DataFrame, devices: DataFrame) -> DataFrame:
    """Settings or actions that name a device the home does not have."""
    known = devices.select("home_id", "device_ref")
    return rows.join(known, ["home_id", "device_ref"], "left_anti")


def device_violations(devices: DataFrame) -> DataFrame:
    caps = F.col("capabilities")
    rules = {
        "device_ref_shape": misshapen(F.col("device_ref"), TOKEN_SHAPE),
        "device_type_shape": misshapen(F.col("device_type"), KEY_SHAPE),
        "capability_count": F.size(caps) > MAX_CAPABILITIES,
        "capability_shape": F.exists(caps, lambda c: misshapen(c, KEY_SHAPE)),
    }
    repeated = over(devices, ["home_id", "device_ref"], 1, "device_ref_repeated")
    return (
        rule_rows(devices, rules, "device_ref")
        .unionByName(repeated)
        .unionByName(over(devices, ["home_id"], MAX_DEVICES, "device_count"))
    )


def setting_violations(settings: DataFrame, devices: DataFrame) -> DataFrame:
    rules = {
        "setting_ref_shape": misshapen(F.col("device_ref"), TOKEN_SHAPE),
        "setting_key_shape": misshapen(F.col("setting_key"), KEY_SHAPE),
        "setting_value_length": F.length("value") > MAX_SETTING_LENGTH,
        "setting_value_missing": F.col("value").isNull(),
    }
    lost = ghosts(settings, devices).select(
        "home_id", F.col("device_ref").alias("item"), F.lit("setting_ghost_device").alias("rule")
    )
    return (
        rule_rows(settings, rules, "device_ref")
        .unionByName(lost)
        .unionByName(over(settings, ["home_id", "device_ref"], MAX_SETTINGS, "setting_count"))
    )


def routine_violations(actions: DataFrame, devices: DataFrame) -> DataFrame:
    rules = {
        "action_ref_shape": misshapen(F.col("device_ref"), TOKEN_SHAPE),
        "action_key_shape": misshapen(F.col("setting_key"), KEY_SHAPE),
        "action_value_length": F.length("value") > MAX_SETTING_LENGTH,
    }
    lost = ghosts(actions, devices).select(
        "home_id",
        F.col("routine_id").cast("string").alias("item"),
        F.lit("action_ghost_device").alias("rule"),
    )
    routines = actions.groupBy("home_id", "routine_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        rule_rows(actions, rules, "routine_id")
        .unionByName(lost)
        .unionByName(over(actions, ["home_id", "routine_id"], MAX_ACTIONS, "action_count"))
        .unionByName(over(routines, ["home_id"], MAX_ROUTINES, "routine_count"))
    )


def violations(devices: DataFrame, settings: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per violation over all profiles."""
    return (
        device_violations(devices)
        .unionByName(setting_violations(settings, devices))
        .unionByName(routine_violations(actions, devices))
    )


def limit_outcomes(
    devices: DataFrame,
    actions: DataFrame,
    settings: DataFrame | None = None,
    max_devices: int = MAX_DEVICES,
    max_routines: int = MAX_ROUTINES,
    max_actions: int = MAX_ACTIONS,
) -> DataFrame:
    """(home_id, n_devices, n_routines, outcome) for every home: `ok`, or the first limit of a profile it breaks."""
    n_devices = devices.groupBy("home_id").agg(F.count(F.lit(1)).alias("n_devices"))
    per_routine = actions.groupBy("home_id", "routine_id").agg(F.count(F.lit(1)).alias("n"))
    n_routines = per_routine.groupBy("home_id").agg(
        F.count(F.lit(1)).alias("n_routines"), F.max("n").alias("max_actions")
    )
    sized = n_devices.join(n_routines, "home_id", "left").na.fill(0, ["n_routines", "max_actions"])
    sized = sized.withColumn("crowded", F.lit(False))
    if settings is not None:
        crowded = over(settings, ["home_id", "device_ref"], MAX_SETTINGS, "x").select("home_id").distinct()
        sized = sized.drop("crowded").join(crowded.withColumn("crowded", F.lit(True)), "home_id", "left")
    outcome = (
        F.when(F.col("n_devices") > max_devices, "device_count")
        .when(F.col("n_routines") > max_routines, "routine_count")
        .when(F.col("max_actions") > max_actions, "action_count")
        .when(F.col("crowded"), "setting_count")
        .otherwise("ok")
    )
    return sized.select("home_id", "n_devices", "n_routines", outcome.alias("outcome"))


def within_limits(devices: DataFrame, actions: DataFrame, settings: DataFrame | None = None, **limits: int) -> DataFrame:
    """Homes whose counts fit a profile. Everything that gathers lists starts from these."""
    return limit_outcomes(devices, actions, settings, **limits).filter("outcome = 'ok'").drop("outcome")


def onboardable(devices: DataFrame, existing: DataFrame) -> DataFrame:
    """Homes whose device list is valid and that have no profile yet."""
    homes = devices.groupBy("home_id").agg(F.count(F.lit(1)).alias("devices_connected"))
    invalid = device_violations(devices).select("home_id")
    return homes.join(existing.select("home_id"), "home_id", "left_anti").join(
        invalid, "home_id", "left_anti"
    )


def routine_commands(actions: DataFrame, devices: DataFrame) -> DataFrame:
    """Actions grouped to one command per device; the last action on a key wins.

    A routine with any action on an unknown device or an undeclared key gives no command at all.
    """
    declared = devices.select("home_id", "device_ref", "capabilities")
    checked = actions.join(declared, ["home_id", "device_ref"], "left").withColumn(
        "fits", F.coalesce(F.array_contains("capabilities", F.col("setting_key")), F.lit(False))
    )
    order = F.struct(*[F.col(c) for c in ACTION_ORDER])
    per_key = checked.groupBy("home_id", "routine_id", "device_ref", "setting_key").agg(
        F.max_by("value", order).alias("value"), F.every("fits").alias("fits")
    )
    broken = per_key.filter(~F.col("fits")).select("home_id", "routine_id").distinct()
    runnable = per_key.join(broken, ["home_id", "routine_id"], "left_anti")
    # declared keys only, so a command has at most MAX_CAPABILITIES entries
    entries = F.array_sort(F.collect_list(F.struct("setting_key", "value")))
    return runnable.groupBy("home_id", "routine_id", "device_ref").agg(
        F.to_json(F.map_from_entries(entries)).alias("command")
    )


def text_identifiers(texts: DataFrame) -> DataFrame:
    """(source, id, rule) for every identifier rule that a text of (source, id, text) breaks.

    The compatibility form is computed once per text, in its own column, before the rules.
    """
    folded = texts.withColumn("_folded", privacy.compatibility_form(F.col("text")))
    rules = privacy.value_rules(F.col("text"), F.col("_folded"))
    hits = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules.items()]))
    return folded.select("source", "id", F.explode(hits).alias("rule"))


def key_identifiers(keys: DataFrame, key: str) -> DataFrame:
    """(key, rule, n) over the distinct keys of a table."""
    counted = keys.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    folded = counted.withColumn("_folded", privacy.compatibility_form(F.col("key")))
    rules = privacy.key_rules(F.col("key"), F.col("_folded"))
    hits = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules.items()]))
    return folded.select("key", "n", F.explode(hits).alias("rule"))
