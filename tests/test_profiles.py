import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hearken.sources import profiles

GOOD = {
    "schema_version": "1.0.0",
    "devices": [{"device_ref": "a", "device_type": "washer", "capabilities": ["power"]}, {"device_ref": "b", "device_type": "oven"}],
    "settings": {"a": {"power": True, "timer_min": 20}, "b": {}},
    "routines": [{"trigger": {"type": "time", "params": {"at": "22:00"}}, "actions": [{"device_ref": "a", "setting_key": "power", "value": "on"}]}],
    "reserved_wellness": {},
}


def landed(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "home_id long, payload string")


def test_long_tables(spark):
    df = landed(spark, json.dumps(GOOD))
    assert rows(profiles.devices(df)) == [(0, 0, "a", "washer", ["power"]), (0, 1, "b", "oven", None)]
    assert rows(profiles.settings(df)) == [(0, "a", "power", "true"), (0, "a", "timer_min", "20")]
    assert rows(profiles.actions(df), "routine_id", "line_no", "device_ref", "value") == [(0, 0, "a", "on")]
    assert profiles.shape_violations(df).count() == 0


@pytest.mark.parametrize(
    "change, outcome",
    [
        ({}, "accepted"), ({"schema_version": "2"}, "version"), ({"x": 1}, "unknown_key"), ({"devices": {}}, "devices_not_array"),
        ({"settings": None}, "settings_not_object"), ({"routines": "x"}, "routines_not_array"),
        ({"reserved_wellness": []}, "reserved_not_object"), ({"reserved_wellness": {"a": 1}}, "reserved_not_empty"),
    ],
)
def test_payload_outcome(spark, change, outcome):
    df = landed(spark, json.dumps({**GOOD, **change}))
    assert df.select(profiles.profile_reason(F.col("payload"))).first()[0] == outcome


def test_missing_member_and_size(spark):
    short = {k: v for k, v in GOOD.items() if k != "reserved_wellness"}
    big = {**GOOD, "settings": {"a": {"power": "x" * 140000}}}
    df = landed(spark, json.dumps(short), json.dumps(big), json.dumps(GOOD) + " {}")
    got = [r[0] for r in df.orderBy("home_id").select(profiles.profile_reason(F.col("payload"))).collect()]
    assert got[:2] == ["missing_key", "too_large"] and got[2] in ("trailing_text", "not_json")


def test_nested_shapes(spark):
    bad = json.loads(json.dumps(GOOD))
    bad["devices"][0]["nickname"] = "x"
    del bad["devices"][1]["device_type"]
    bad["settings"]["a"] = {"power": [1], "timer_min": 10**25, "mode": None}
    bad["routines"].append({"trigger": {"params": {}}, "actions": []})
    bad["routines"].append({"actions": [{"device_ref": "a", "note": 1}]})
    found = rows(profiles.shape_violations(landed(spark, json.dumps(bad))), "rule", "item")
    assert ("device_unknown_key", "0") in found and ("device_missing_key", "1") in found
    assert ("trigger_missing_key", "1") in found and ("actions_empty", "1") in found
    assert ("routine_missing_key", "2") in found
    assert ("action_missing_key", "2.0") in found and ("action_unknown_key", "2.0") in found
    kinds = [r for r, _ in found if r.startswith("setting")]
    assert kinds.count("setting_not_scalar") == 2 and "setting_too_many_digits" in kinds
