"""Records, crosswalk and payloads on small hand-made homes."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hearken.functions.payloads import command_reason
from hearken.operators import commands, crosswalk, fleet, store

DEVICES = "home_id long, pos long, device_ref string, device_type string, capabilities array<string>"
ACTIONS = "home_id long, routine_id long, line_no int, part_no int, supp_no int, device_ref string, setting_key string, value string"
SETTINGS = "home_id long, device_ref string, setting_key string, value string"


def sample(spark, n_devices=5, n_routines=3, homes=2):
    keys = ["power", "mode", "eco_mode"]
    devices = [(h, d, f"dev{d:03d}", "washer", keys) for h in range(homes) for d in range(n_devices)]
    settings = [(h, ref, key, "true" if key != "mode" else "auto") for h, _, ref, _, own in devices for key in own]
    actions = [
        (h, r, line, 0, 0, f"dev{(r + line) % n_devices:03d}", keys[line], "true" if keys[line] != "mode" else "auto")
        for h in range(homes) for r in range(n_routines) for line in range(2) if n_devices
    ]
    made = zip((devices, settings, actions), (DEVICES, SETTINGS, ACTIONS))
    return tuple(spark.createDataFrame(rows, schema) for rows, schema in made)


def records_of(spark, **kw):
    devices, settings, actions = sample(spark, **kw)
    homes = fleet.within_limits(devices, actions, settings)
    return devices, settings, actions, store.split(homes, devices, settings, actions)


@pytest.mark.parametrize("shape", [(5, 3), (12, 8), (30, 20)])
def test_split_merge_round_trip(spark, shape):
    devices, settings, actions, records = records_of(spark, n_devices=shape[0], n_routines=shape[1])
    assert fleet.violations(devices, settings, actions).count() == 0
    merged = store.merge(records).collect()
    assert len(merged) == 2
    profile = json.loads(merged[0]["profile"])
    assert [d["device_ref"] for d in profile["devices"]] == [f"dev{i:03d}" for i in range(shape[0])]
    assert len(profile["routines"]) == shape[1] and set(profile["settings"]) == {d["device_ref"] for d in profile["devices"]}
    assert "_settings" not in profile["devices"][0]
    report = store.size_report(records, store.device_records(devices, settings)).first()
    assert report["total_bytes"] == len(merged[0]["profile"].encode())
    assert report["n_keys"] == 1 + sum(shape) and report["per_key_ok"]


def test_merge_refuses_half_profiles(spark):
    *_rest, records = records_of(spark, homes=1)
    assert store.merge_audit(records).first()["outcome"] == "ok"
    cases = {
        "record_missing": records.filter("name <> 'device:dev001'"),
        "meta_missing": records.filter("name <> 'meta'"),
        "record_unreferenced": records.unionByName(records.filter("name = 'meta'").withColumn("name", F.lit("device:ghost"))),
        "meta_invalid": records.withColumn("payload", F.when(F.col("name") == "meta", F.lit('{"device_refs":["dev000"],"routine_count":-1}')).otherwise(F.col("payload"))),
    }
    for outcome, tampered in cases.items():
        assert store.merge_audit(tampered).first()["outcome"] == outcome
        assert store.merge(tampered).count() == 0


def test_large_homes_are_not_split(spark):
    *_rest, records = records_of(spark, n_devices=31)
    assert records.count() == 0


def test_erase_is_all_or_nothing_and_residue_is_unknown_without_meta(spark):
    *_rest, records = records_of(spark)
    asked = spark.createDataFrame([(0, "device:dev000"), (0, "device:nope"), (1, "meta"), (1, "meta")], "home_id long, name string")
    audit = rows(store.erase_audit(records, asked))
    assert audit == [(0, 2, 1, False), (1, 1, 0, True)]
    after = store.erase(records, asked)
    assert after.count() == records.count() - 1
    revoked = spark.createDataFrame([(0,), (1,), (7,)], "home_id long")
    assert rows(store.residue(revoked, records, after)) == [(0, 9), (1, 8), (7, None)]


def test_violation_rules(spark):
    devices = spark.createDataFrame(
        [(1, 0, "ok", "washer", ["power"]), (1, 1, "ok", "washer", ["Power"]), (1, 2, "엄마", "W", ["a"] * 13)], DEVICES
    )
    settings = spark.createDataFrame([(1, "ok", "이름", "v" * 65), (1, "gone", "power", None)], SETTINGS)
    actions = spark.createDataFrame([(1, 1, i, 0, 0, "ok", "power", "on") for i in range(11)], ACTIONS)
    found = {r["rule"] for r in fleet.violations(devices, settings, actions).collect()}
    assert found == {
        "device_ref_shape", "device_ref_repeated", "device_type_shape", "capability_shape", "capability_count",
        "setting_key_shape", "setting_value_length", "setting_value_missing", "setting_ghost_device", "action_count",
    }


def crosswalk_of(spark):
    old = spark.createDataFrame(
        [(1, 0, "a", "washer", ["power"]), (1, 1, "b", "washer", ["power"]), (1, 2, "c", "oven", ["mode"]), (2, 0, "x", "oven", ["mode"])], DEVICES
    )
    new = spark.createDataFrame(
        [(1, 0, "n1", "washer", ["power"]), (1, 1, "n2", "light", ["power"]), (1, 2, "n3", "oven", ["timer_min"])]
        + [(2, i, f"m{i}", "oven", ["mode"]) for i in range(31)],
        DEVICES,
    )
    settings = spark.createDataFrame([(1, "a", "power", "on"), (1, "b", "power", "on"), (1, "c", "mode", "cool"), (2, "x", "mode", "dry")], SETTINGS)
    actions = spark.createDataFrame(
        [(1, 1, 0, 0, 0, "a", "power", "on"), (1, 2, 0, 0, 0, "a", "power", "on"), (1, 2, 1, 0, 0, "c", "mode", "cool"), (2, 1, 0, 0, 0, "x", "mode", "dry")], ACTIONS
    )
    return old, new, settings, actions


def test_crosswalk_conserves_every_item(spark):
    old, new, settings, actions = crosswalk_of(spark)
    homes = crosswalk.movable(old, new)
    matches = crosswalk.match_devices(old, new, homes)
    assert rows(matches, "home_id", "old_ref", "new_ref", "reason") == [
        (1, "a", "n1", None), (1, "b", None, "no_matching_type"), (1, "c", "n3", None), (2, "x", None, "mapping_aborted"),
    ]
    mapped = crosswalk.map_settings(settings, matches)
    assert rows(mapped, "device_ref", "reason") == [("a", None), ("b", "no_matching_type"), ("c", "capability_unsupported"), ("x", "mapping_aborted")]
    routines = crosswalk.map_routines(actions, matches, homes)
    assert rows(routines) == [(1, 1, None), (1, 2, "routine_action_unmappable"), (2, 1, "mapping_aborted")]
    assert rows(crosswalk.unmatched_new(new, homes, matches)) == [(1, "n2")]
    moved = crosswalk.remapped_actions(actions, matches, routines)
    assert rows(moved, "routine_id", "new_ref") == [(1, "n1")]
    totals = {r["kind"]: r["n"] for r in crosswalk.report(matches, mapped, routines).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    assert totals == {"device": 4, "setting": 4, "routine": 3}


def test_crosswalk_reports_homes_beyond_the_limits(spark):
    old, settings, actions = sample(spark, n_devices=31, n_routines=2, homes=1)
    homes = crosswalk.movable(old, old)
    matches = crosswalk.match_devices(old, old, homes)
    mapped, routines = crosswalk.map_settings(settings, matches), crosswalk.map_routines(actions, matches, homes)
    report = rows(crosswalk.report(matches, mapped, routines), "kind", "outcome", "n")
    assert report == [("device", "profile_rejected", 31), ("routine", "profile_rejected", 2), ("setting", "profile_rejected", 93)]
    assert crosswalk.unmatched_new(old, homes, matches).count() == 0


@pytest.mark.parametrize(
    "shape, outcome", [((5, 3), "ok"), ((30, 20), "ok"), ((31, 3), "device_count"), ((5, 21), "routine_count"), ((5, 0), "ok")]
)
def test_every_home_has_an_outcome(spark, shape, outcome):
    devices, settings, actions = sample(spark, n_devices=shape[0], n_routines=shape[1])
    assert rows(fleet.limit_outcomes(devices, actions, settings), "home_id", "outcome") == [(0, outcome), (1, outcome)]


def test_outcomes_of_crowded_devices_and_routines(spark):
    devices, settings, actions = sample(spark, homes=1)
    crowded = spark.createDataFrame([(0, "dev000", f"k{i}", "v") for i in range(13)], SETTINGS)
    long = spark.createDataFrame([(0, 0, i, 0, 0, "dev000", "power", "on") for i in range(11)], ACTIONS)
    assert fleet.limit_outcomes(devices, actions, crowded).first()["outcome"] == "setting_count"
    assert fleet.limit_outcomes(devices, long, settings).first()["outcome"] == "action_count"


def test_onboarding_needs_a_valid_list_and_an_empty_store(spark):
    devices, *_ = sample(spark, homes=3)
    bad = devices.withColumn("device_type", F.when(F.col("home_id") == 2, F.lit("X")).otherwise(F.col("device_type")))
    existing = spark.createDataFrame([(1,)], "home_id long")
    assert rows(fleet.onboardable(bad, existing)) == [(0, 5)]


def test_routine_commands_last_write_wins(spark):
    devices = spark.createDataFrame([(1, 0, "a", "washer", ["power", "mode"])], DEVICES)
    actions = spark.createDataFrame(
        [(1, 1, 0, 0, 0, "a", "power", "on"), (1, 1, 1, 0, 0, "a", "power", "off"), (1, 1, 2, 0, 0, "a", "mode", "dry"),
         (1, 2, 0, 0, 0, "a", "power", "on"), (1, 2, 1, 0, 0, "ghost", "power", "on")],
        ACTIONS,
    )
    assert rows(fleet.routine_commands(actions, devices)) == [(1, 1, "a", '{"mode":"dry","power":"off"}')]


@pytest.mark.parametrize(
    "payload, outcome",
    [
        (b'{"v":1,"device_ref":"d","set":{"power":true}}', "accepted"),
        (b'\xef\xbb\xbf{"v":1,"device_ref":"d","set":{}}', "accepted"),
        (b'{"v":1,"device_ref":"d","set":{"a":"}{"}}  ', "accepted"),
        (None, "missing"),
        (b"x" * 1025, "too_large"),
        (b'{"v":1,"device_ref":"\xff","set":{}}', "not_utf8"),
        (b'{"v":1,', "not_json"),
        (b"", "not_json"),
        (b'{"v":1,"device_ref":"d","set":{"a":1,"a":2}}', "repeated_key"),
        (b"[1]", "not_an_object"),
        (b'"text"', "not_an_object"),
        (b'{"v":1,"device_ref":"d","set":{}} x', "trailing_text"),
        (b'{"v":1,"device_ref":"d","set":{}}{}', "trailing_text"),
        (b'{"v":2,"device_ref":"d","set":{}}', "version"),
        (b'{"device_ref":"d","set":{}}', "version"),
        (b'{"v":1,"device_ref":7,"set":{}}', "device_ref"),
        (b'{"v":1,"set":{}}', "device_ref"),
        (b'{"v":1,"device_ref":"d","set":[1]}', "set"),
        (b'{"v":1,"device_ref":"d"}', "set"),
    ],
)
def test_payload_outcomes(spark, payload, outcome):
    df = spark.createDataFrame([(bytearray(payload) if payload is not None else None,)], "p binary")
    # text is compared as the bytes it came from
    assert df.select(command_reason(F.col("p").cast("string"))).first()[0] == outcome


def test_command_items(spark):
    items = [
        ("power", "true", "boolean", None), ("power", "1", "integer", "not_boolean"), ("mode", "dry", "string", None),
        ("mode", "boil", "string", "not_a_choice"), ("mode", "1", "integer", "not_string"), ("target_temp", "40", "integer", None),
        ("target_temp", "41", "integer", "out_of_range"), ("target_temp", "true", "boolean", "not_integer"),
        ("target_temp", "20.5", "number", "not_integer"), ("warp", "1", "integer", "unknown_capability"), (None, "1", "integer", "unknown_capability"),
    ]
    df = spark.createDataFrame(items, "c string, v string, t string, want string")
    got = df.select("want", commands.item_error(F.col("c"), F.col("v"), F.col("t")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


@pytest.mark.parametrize("tail, outcome", [("", "accepted"), (" x", "trailing_text"), ("}", "trailing_text"), ("]x", "trailing_text"),
                                           (" {}", "trailing_text"), (", 1", "trailing_text"), (",null", "trailing_text"), ("  ", "accepted")])
def test_long_and_deep_payloads(spark, tail, outcome):
    from hearken.functions.payloads import reject_reason

    deep = "[" * 20 + '"' + "\\u00e9x" * 15_000 + '"' + "]" * 20
    payload = '{"v":"1","set":{"k":' + deep + "}}" + tail
    row = spark.createDataFrame([(payload.encode(),)], "payload binary").select(reject_reason(F.col("payload"), 500_000, "$.v", "1").alias("r"))
    assert row.first()["r"] == outcome


def test_lengths_keep_cells_apart(spark):
    from hearken.functions.hashing import row_digest

    rows = spark.createDataFrame([("a\x1f1=b", "c"), ("a", "b\x1f1=c"), (None, ""), ("", None)], "a string, b string")
    assert rows.select(row_digest(F.col("a"), F.col("b"))).distinct().count() == 4
