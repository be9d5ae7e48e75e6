"""Steps that decide how queries grow: what is read once, joined once, parsed once, and what is not shuffled."""

import numpy as np
import pyarrow.parquet as pq
from conftest import FOLDER, rows
from pyspark.sql import Row
from pyspark.sql import functions as F

from hearken.operators import kmeans, mart, segments, store
from hearken.plans import homes, models
from hearken.plans.registry import Inputs
from hearken.sources import profiles
from hearken.streaming import stateful


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


class Counting(Inputs):
    """Counts how often a table is asked for."""

    def __init__(self, *args):
        super().__init__(*args)
        self.asked = {}

    def __getattr__(self, name):
        self.__dict__["asked"][name] = self.__dict__["asked"].get(name, 0) + 1
        return super().__getattr__(name)


def test_homes_read_the_order_lines_once(spark):
    t = Counting(spark, FOLDER)
    homes.stored(t), homes.requests(t), homes.actions(t), homes.devices(t)
    assert t.asked["lineitem"] == 1


def test_devices_and_actions_are_the_rows_of_the_views(spark):
    t = Inputs(spark, FOLDER)
    wide = homes.devices(t).select("home_id", "pos", "device_ref", "device_type", F.col("capabilities")[0], F.col("capabilities")[1])
    assert rows(wide) == rows(t.v_devices)
    assert rows(homes.actions(t), *t.v_actions.columns) == rows(t.v_actions)


def test_homes_are_counted_once_per_crosswalk(spark):
    t = Inputs(spark, FOLDER)
    counted, matches = homes.moved(t)
    assert "Aggregate" not in plan_of(counted) and "Aggregate" not in plan_of(matches)


def test_erase_audit_needs_no_join_and_null_names_are_unknown(spark):
    schema = "home_id long, name string"
    records = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b"), (None, "c")], schema)
    asked = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (2, "b"), (None, "c")], schema)
    audit = store.erase_audit(records, asked)
    assert "Join" not in plan_of(audit)
    assert rows(audit) == sorted([(1, 2, 1, False), (2, 1, 0, True), (None, 1, 1, False)], key=repr)
    assert rows(store.erase(records, asked)) == sorted([(1, "a"), (1, "a"), (1, None), (None, "c")], key=repr)


def test_a_payload_is_parsed_once_for_all_its_members(spark):
    whole = '{"schema_version":"1.0.0","devices":[],"settings":{},"routines":[],"reserved_wellness":{}}'
    bad = {
        "accepted": whole, "missing": None, "devices_not_array": whole.replace('"devices":[]', '"devices":{}'),
        "settings_not_object": whole.replace('"settings":{}', '"settings":1'), "missing_key": whole.replace('"settings":{},', ""),
        "reserved_not_empty": whole.replace("{}}", '{"a":1}}'), "trailing_text": whole + "}", "not_json": "{",
    }
    df = spark.createDataFrame(list(bad.items()), "want string, payload string")
    judged = df.withColumn("got", profiles.profile_reason(F.col("payload")))
    assert all(r["want"] == r["got"] for r in judged.collect())
    assert plan_of(judged).count("regexp_replace(") <= 3


def test_mart_rows_are_written_without_a_shuffle(spark, tmp_path):
    runs = spark.createDataFrame([("r1", "real", "g", "passed")], "run_id string, data_mode string, source_type string, gate_status string")
    told = spark.range(0, 30, 1, 3).select(F.lit("r1").alias("run_id"), F.col("id").cast("string").alias("text"))
    mart.load(spark, str(tmp_path), runs.withColumn("created_at", F.current_timestamp()), {"testimony": told})
    files = sorted((tmp_path / "testimony" / "run_id=r1").glob("*.parquet"))
    assert len(files) == 3  # one of each task; a shuffle would have put a small run into one
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}


class State:
    def __init__(self):
        self.cell = None

    def get(self):
        return self.cell

    def update(self, cell):
        self.cell = cell


def test_changes_are_found_on_plain_rows():
    keep = stateful.KeepChanges()
    keep.current, keep.due = State(), None
    command = Row("device", "capability", "at", "seq", "value")

    def changes(*cells):
        return [(r["seq"], r["old"], r["new"]) for r in keep.handleInputRows(None, iter([command(1, "a", *c) for c in cells]), None)]

    assert changes((5, 2, 7), (5, 1, 7), (6, 3, 8)) == [(1, None, 7), (3, 7, 8)]
    assert changes((9, 4, 8), (9, 5, 8)) == [] and changes((10, 6, 1)) == [(6, 8, 1)]


def test_silhouettes_look_a_segment_up_once_a_row(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0), (0.0, 1.0, 0), (9.0, 9.0, 1), (9.0, 8.0, 1), (5.0, 5.0, 2)], "a double, b double, segment int")
    told = segments.silhouette(df, ["a", "b"])
    assert plan_of(told).count("filter(") == 2
    x, s = np.array([r[:2] for r in df.collect()]), [0, 0, 1, 1, 2]
    far = ((x[:, None] - x) ** 2).sum(axis=2)
    want = []
    for i in range(5):
        means = {k: np.mean([far[i, j] for j in range(5) if s[j] == k and (j != i or k != s[i])]) for k in {0, 1, 2} if (k != s[i] or s.count(k) > 1)}
        if s.count(s[i]) == 1:
            want.append(0.0)
            continue
        a, b = means[s[i]], min(v for k, v in means.items() if k != s[i])
        want.append((b - a) / max(a, b))
    assert abs(told.first()[0] - np.mean(want)) < 1e-12


def test_nearest_centres_of_many_features_are_found_in_batches(spark):
    names = [f"f{i}" for i in range(14)]
    df = spark.createDataFrame([[float(i)] * 14 for i in range(6)], ", ".join(f"{c} double" for c in names))
    near = kmeans.nearest(names, np.array([[5.0] * 14, [0.0] * 14, [0.0] * 14]))
    told = df.select("f0", near.alias("n"))
    assert "ArrowEvalPython" in plan_of(told)
    assert rows(told.select("f0", "n.distance", "n.cluster"))[:2] == [(0.0, 0.0, 1), (1.0, 14.0, 1)]


def test_answers_in_one_file_are_clustered_on_all_cores(spark):
    t = Inputs(spark, FOLDER)
    assert len(t.customer.inputFiles()) == 1
    assert len(models.standard_features(t).inputFiles()) > 1
