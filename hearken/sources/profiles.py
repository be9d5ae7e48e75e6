"""Landed home profiles (home_id, payload) as JSON text: accept or reject, shape rules, long tables.

A payload is one row of bounded size, so everything here stays inside the row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions.fixed_values import (
    ACTION_KEYS,
    DEVICE_KEYS,
    MAX_INT_DIGITS,
    MAX_TRIGGER_PARAMS,
    PROFILE_KEYS,
    ROUTINE_KEYS,
    SCHEMA_VERSION,
    STORE_BUDGET,
    TRIGGER_KEYS,
)
from hearken.functions.payloads import as_text, bound, reject_reason

PROFILE = (
    "devices array<struct<device_ref:string,device_type:string,capabilities:array<string>>>, "
    "settings map<string,map<string,string>>, "
    "routines array<struct<trigger:struct<type:string,params:map<string,string>>,"
    "actions:array<struct<device_ref:string,setting_key:string,value:string>>>>"
)
SCALARS = ("STRING", "BOOLEAN", "BIGINT", "DOUBLE", "FLOAT")


def keys_of(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))


def profile_reason(payload: Column) -> Column:
    """Why a payload is rejected before its content is looked at, or 'accepted'."""
    first = reject_reason(payload, STORE_BUDGET, "$.schema_version", SCHEMA_VERSION)
    wanted = F.array(*[F.lit(k) for k in PROFILE_KEYS])

    def keyed(keys: Column) -> Column:
        return F.when(F.size(F.array_except(keys, wanted)) > 0, "unknown_key").when(
            F.size(F.array_except(wanted, keys)) > 0, "missing_key"
        )

    def typed(parsed: Column) -> Column:
        def not_a(kind: str, path: str) -> Column:
            member = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
            return ~F.coalesce(member.startswith(kind), F.lit(False))

        return (
            F.when(not_a("ARRAY", "$.devices"), "devices_not_array")
            .when(not_a("OBJECT", "$.settings"), "settings_not_object")
            .when(not_a("ARRAY", "$.routines"), "routines_not_array")
            .when(not_a("OBJECT", "$.reserved_wellness"), "reserved_not_object")
        )

    def shaped(text: Column) -> Column:
        reserved = keys_of(F.get_json_object(text, "$.reserved_wellness"))
        filled = F.when(F.size(reserved) > 0, "reserved_not_empty").otherwise("accepted")
        return F.coalesce(bound(keys_of(text), keyed), bound(F.try_parse_json(text), typed), filled)

    return F.when(first != "accepted", first).otherwise(bound(as_text(payload), shaped))


def accepted(profiles: DataFrame) -> DataFrame:
    return profiles.filter(profile_reason(F.col("payload")) == "accepted")


def parsed(profiles: DataFrame) -> DataFrame:
    return profiles.select("home_id", F.from_json(as_text(F.col("payload")), PROFILE).alias("p"))


def devices(profiles: DataFrame) -> DataFrame:
    rows = parsed(profiles).select("home_id", F.posexplode("p.devices").alias("pos", "d"))
    return rows.select("home_id", F.col("pos").cast("bigint").alias("pos"), "d.*")


def settings(profiles: DataFrame) -> DataFrame:
    per_device = parsed(profiles).select("home_id", F.explode("p.settings").alias("device_ref", "kv"))
    return per_device.select("home_id", "device_ref", F.explode("kv").alias("setting_key", "value"))


def actions(profiles: DataFrame) -> DataFrame:
    """Actions with routine and step numbers; the tie-break columns of other sources are 0."""
    routines = parsed(profiles).select("home_id", F.posexplode("p.routines").alias("routine_id", "r"))
    steps = routines.select(
        "home_id", F.col("routine_id").cast("bigint").alias("routine_id"),
        F.posexplode("r.actions").alias("line_no", "a"),
    )
    return steps.select(
        "home_id", "routine_id", "line_no", F.lit(0).alias("part_no"), F.lit(0).alias("supp_no"), "a.*"
    )


def shape_violations(profiles: DataFrame) -> DataFrame:
    """(home_id, rule, item): unknown or missing keys of nested objects and settings that are no
    scalars. Items are positions; keys and values of untrusted payloads are not repeated."""
    text = as_text(F.col("payload"))
    base = profiles.select("home_id", text.alias("text"))

    def elements(df: DataFrame, json: Column, pos: str) -> DataFrame:
        items = F.from_json(json, "array<string>")
        return df.select("*", F.posexplode(items).alias(pos, "body"))

    def check(df: DataFrame, what: str, item: Column, allowed: tuple, required: tuple) -> DataFrame:
        keys = keys_of(F.col("body"))
        allow, need = F.array(*[F.lit(k) for k in allowed]), F.array(*[F.lit(k) for k in required])
        rules = F.array_compact(
            F.array(
                F.when(F.json_object_keys("body").isNull(), f"{what}_not_object"),
                F.when(F.size(F.array_except(keys, allow)) > 0, f"{what}_unknown_key"),
                F.when(F.size(F.array_except(need, keys)) > 0, f"{what}_missing_key"),
            )
        )
        return df.select("home_id", item.cast("string").alias("item"), F.explode(rules).alias("rule"))

    device = elements(base, F.get_json_object("text", "$.devices"), "pos")
    routine = elements(base, F.get_json_object("text", "$.routines"), "pos")
    trigger = routine.withColumn("body", F.get_json_object("body", "$.trigger"))
    steps = routine.select("home_id", "pos", F.get_json_object("body", "$.actions").alias("steps"))
    action = elements(steps, F.col("steps"), "step")
    crowded = trigger.filter(
        F.size(keys_of(F.get_json_object("body", "$.params"))) > MAX_TRIGGER_PARAMS
    ).select("home_id", F.col("pos").cast("string").alias("item"), F.lit("trigger_param_count").alias("rule"))
    empty = steps.filter(F.coalesce(F.json_array_length("steps"), F.lit(0)) == 0).select(
        "home_id", F.col("pos").cast("string").alias("item"), F.lit("actions_empty").alias("rule")
    )
    step = F.concat_ws(".", F.col("pos").cast("string"), F.col("step").cast("string"))

    typed = base.select(
        "home_id",
        F.explode(
            F.try_variant_get(F.try_parse_json("text"), "$.settings", "map<string,map<string,variant>>")
        ).alias("ref", "kv"),
    )
    cells = typed.select("home_id", "ref", F.posexplode("kv").alias("item", "key", "value"))
    kind = F.schema_of_variant("value")
    number = kind.startswith("DECIMAL") | kind.isin("BIGINT")
    digits = F.length(F.regexp_replace(F.try_variant_get("value", "$", "string"), "[^0-9]", ""))
    problem = F.when(~(kind.isin(*SCALARS) | kind.startswith("DECIMAL")), "setting_not_scalar").when(
        number & (digits > MAX_INT_DIGITS), "setting_too_many_digits"
    )
    setting = cells.select(
        "home_id", F.col("item").cast("string").alias("item"), problem.alias("rule")
    ).filter("rule is not null")
    return (
        check(device, "device", F.col("pos"), DEVICE_KEYS, DEVICE_KEYS[:2])
        .unionByName(check(routine, "routine", F.col("pos"), ROUTINE_KEYS, ROUTINE_KEYS))
        .unionByName(check(trigger.filter("body is not null"), "trigger", F.col("pos"), TRIGGER_KEYS, TRIGGER_KEYS[:1]))
        .unionByName(check(action, "action", step, ACTION_KEYS, ACTION_KEYS))
        .unionByName(empty)
        .unionByName(crowded)
        .unionByName(setting)
    )
