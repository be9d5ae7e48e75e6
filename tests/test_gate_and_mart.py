"""One mutation per rule of a consistent bundle, and an idempotent mart."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hearken.functions import hashing
from hearken.functions.fixed_values import FEATURE_HEADERS
from hearken.operators import gate, mart

META = dict(
    bundle_id="b", collect_run="r1", prep_run="r1", pp_run="r1", status="ok", collect_source="google_play",
    prep_source="google_play", pp_source="google_play", warning=None, app_id="app", n_reviews=45,
)
META_DDL = (
    "bundle_id string, collect_run string, prep_run string, pp_run string, status string, collect_source string, "
    "prep_source string, pp_source string, warning string, app_id string, n_reviews long"
)
POINTS = [("b", 1, "16", "2.0", "44.4", "44.4", "quote"), ("b", 2, "11", "2.0", "30.6", "30.6", "q"), ("b", 3, "9", "2.0", "25.0", "25.0", "q")]
POINT_DDL = "bundle_id string, row_no int, freq string, avg_rating string, mention_all_pct string, mention_assigned_pct string, rep_review string"


def meta(spark, **change):
    row = {**META, **change}
    return spark.createDataFrame([tuple(row[k] for k in META)], META_DDL)


def broken(df):
    return sorted(r["rule"] for r in df.collect())


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, []),
        ({"prep_run": "r2"}, ["run_id_mismatch"]),
        ({"pp_run": " "}, ["run_id_blank"]),
        ({"collect_run": None}, ["run_id_blank"]),
        ({"status": "failed"}, ["status_not_ok"]),
        ({"status": None}, ["status_not_ok"]),
        ({"collect_source": "synthetic_demo"}, ["painpoint_source_differs", "preprocess_source_differs", "source_not_real"]),
        ({"prep_source": "x"}, ["preprocess_source_differs"]),
        ({"pp_source": None}, ["painpoint_source_differs"]),
        ({"warning": "demo"}, ["demo_warning"]),
        ({"app_id": ""}, ["app_id_missing"]),
    ],
)
def test_meta_rules(spark, change, expected):
    m = meta(spark, **change)
    assert broken(gate.run_ids(m).unionByName(gate.source_chain(m))) == expected


@pytest.mark.parametrize(
    "column, value, expected",
    [
        ("freq", "1.5", "freq_invalid"), ("freq", "0", "freq_invalid"), ("freq", "x", "freq_invalid"),
        ("avg_rating", "nan", "rating_invalid"), ("avg_rating", "5.1", "rating_invalid"),
        ("mention_all_pct", "-1", "mention_all_invalid"), ("mention_assigned_pct", "100.1", "mention_assigned_invalid"),
        ("rep_review", "  ", "quote_blank"), ("rep_review", None, "quote_blank"),
    ],
)
def test_cell_rules(spark, column, value, expected):
    points = spark.createDataFrame(POINTS, POINT_DDL)
    assert broken(gate.ranges(points)) == []
    bad = points.withColumn(column, F.when(F.col("row_no") == 2, F.lit(value)).otherwise(F.col(column)))
    found = gate.ranges(bad).collect()
    assert [(r["rule"], r["detail"]) for r in found] == [(expected, "row 2")]


@pytest.mark.parametrize(
    "negative, noise, expected",
    [
        (36, 0, []),
        (37, 1, ["mention_not_reproducible"] * 3),
        (36, 1, ["freq_sum_differs"]),
        (0, 0, ["freq_sum_differs", "negative_count_invalid"]),
        (36, -1, ["freq_sum_differs", "noise_count_invalid"]),
        (None, 0, ["freq_sum_differs", "negative_count_invalid"]),
    ],
)
def test_reconcile(spark, negative, noise, expected):
    points = spark.createDataFrame(POINTS, POINT_DDL)
    counts = spark.createDataFrame([("b", negative, noise)], "bundle_id string, negative_count long, noise_count long")
    found = [r for r in broken(gate.reconcile(points, counts))]
    assert found == expected


def test_strength_range_follows_the_method(spark):
    ddl = "bundle_id string, seq int, rep_review string, rating string, likes string, sentiment_method string"
    data = [
        ("a", 1, "q", "3", "0", "rating_fallback"), ("b", 1, "q", "3", "0", "deep_learning"),
        ("c", 1, "q", "5", "-1", "rating_fallback"), ("d", 1, " ", "5", "1.5", "deep_learning"), ("e", 1, "q", "5", "1", "guess"),
    ]
    found = rows(gate.strengths(spark.createDataFrame(data, ddl)), "bundle_id", "rule")
    assert found == [
        ("a", "rating_outside_method"), ("c", "likes_invalid"), ("d", "likes_invalid"), ("d", "quote_blank"), ("e", "method_unknown"),
    ]


def test_presence_hashes_and_source_column(spark):
    files = spark.createDataFrame([("b", n) for n in gate.REQUIRED_BUNDLE[1:]], "bundle_id string, name string")
    assert rows(gate.presence(meta(spark), files), "detail") == [("reviews_raw.csv",)]
    raw = spark.createDataFrame([("b", i, "t", "google_play") for i in range(45)], "bundle_id string, seq int, review string, source_type string")
    recorded = hashing.fingerprint(raw, ["seq", "review"], ["bundle_id"])
    assert broken(gate.hash_chain(recorded, raw, ["seq", "review"], "x")) == []
    assert broken(gate.hash_chain(recorded, raw.withColumn("review", F.lit("u")), ["seq", "review"], "x")) == ["x"]
    assert broken(gate.source_column(meta(spark), raw)) == []
    short = raw.filter("seq > 0").withColumn("source_type", F.when(F.col("seq") == 3, None).otherwise(F.col("source_type")))
    assert broken(gate.source_column(meta(spark), short)) == ["foreign_source_rows", "row_count_differs"]
    assert broken(gate.source_column(meta(spark), raw.filter("false"))) == ["no_rows"]


def test_first_valid_bundle_wins(spark):
    candidates = spark.createDataFrame([("g", "a", 1), ("g", "b", 2), ("h", "c", 1)], "grp string, bundle_id string, priority int")
    bad = spark.createDataFrame([("a", "x", ""), ("a", "y", ""), ("c", "x", "")], "bundle_id string, rule string, detail string")
    assert rows(gate.first_valid(candidates, bad)) == [("g", "b", "real", 1, 2), ("h", None, "hypothesis", 1, 1)]


def test_mart_load_is_idempotent_and_takes_passed_runs_only(spark, tmp_path):
    base = str(tmp_path / "mart")
    runs = spark.createDataFrame(
        [("r1", "real", "google_play", "passed"), ("r2", "real", "google_play", "failed"), ("r3", "real", "google_play", "passed")],
        "run_id string, data_mode string, source_type string, gate_status string",
    ).withColumn("created_at", F.current_timestamp())
    segments = spark.createDataFrame(
        [("r1", "1.0", "2.0", True), ("r1", "2", "x", False), ("r2", "3", "1", True), ("r3", "4", None, True)],
        "run_id string, respondent_id string, age_band string, is_synthetic boolean",
    ).withColumns({c: F.lit("3.0") for c in (*FEATURE_HEADERS, "segment") if c != "age_band"})
    first = rows(mart.load(spark, base, runs, {"segments": segments}))
    again = rows(mart.load(spark, base, runs, {"segments": segments}))
    assert first == again == [("runs", 2), ("segments", 3)]
    mart.load(spark, base, runs.filter("run_id = 'r3'"), {"segments": segments.filter("respondent_id = '9'")})
    stored = mart.read(spark, base, "segments")
    assert rows(stored, "run_id", "respondent_id", "age_band")[:2] == [("r1", 1, 2), ("r1", 2, None)]
    landed_otherwise = ("app_freq", "bought_wedding", "p1_exp", "p2_exp", "has_watch")
    assert stored.filter(F.least(*landed_otherwise) == 3).count() == 3


def test_mart_columns_are_mapped_or_missed(spark):
    points = spark.createDataFrame([("r1", "t", 4, 2.45, 10.0, 12.5, "q")], "run_id string, topic string, freq long, avg_rating double, mention_all_pct double, mention_assigned_pct double, rep_review string")
    got = mart.conform(points, "painpoints").first()
    assert (float(got["avg_rating"]), float(got["mention_all_neg"]), float(got["mention_assigned"])) == (2.45, 10.0, 12.5)
    with pytest.raises(ValueError, match="mention_all_neg, mention_assigned"):
        mart.conform(points.drop("mention_all_pct", "mention_assigned_pct"), "painpoints")
    rival = spark.createDataFrame([("r1", "t", 4)], "run_id string, review string, rating int").withColumn("date", F.current_date())
    assert mart.conform(rival, "competitor_reviews").first()["app"] == "rival"


def test_constraints(spark):
    runs = spark.createDataFrame([("r1", "passed"), ("r1", "passed"), ("r2", "failed")], "run_id string, gate_status string")
    found = rows(mart.constraint_violations("runs", runs), "rule", "key", "n")
    assert found == [("gate_not_passed", "r2", 1), ("key_repeated", "r1", 2)]
    reviews = spark.createDataFrame([("r1", None, 6), ("r9", "t", 5), ("r1", "t", None)], "run_id string, review string, rating int")
    found = rows(mart.constraint_violations("reviews", reviews, runs=runs), "rule", "key", "n")
    assert found == [("rating_range", "r1", 1), ("review_null", "r1", 1), ("run_missing", "r9", 1)]


def test_reasons_of_passed_over_candidates_are_kept(spark):
    candidates = spark.createDataFrame([("g", "a", 1), ("g", "b", 2), ("g", "c", 3), ("h", "d", 1), ("h", "e", 2)], "grp string, bundle_id string, priority int")
    bad = spark.createDataFrame([("a", "r1", ""), ("a", "r1", "x"), ("a", "r2", ""), ("c", "r1", ""), ("d", "r3", ""), ("e", "r1", "")], "bundle_id string, rule string, detail string")
    assert rows(gate.rejections(candidates, bad), "grp", "bundle_id", "rule", "n") == [
        ("g", "a", "r1", 2), ("g", "a", "r2", 1), ("h", "d", "r3", 1), ("h", "e", "r1", 1)]
    assert rows(gate.rejections(candidates, bad.limit(0))) == []


def test_a_table_without_strengths_is_not_reported_rather_than_rejected(spark):
    bundles = spark.createDataFrame([("a",), ("b",), ("c",)], "bundle_id string")
    cells = spark.createDataFrame(
        [("a", 1, "gut", "5", "0", "rating_fallback"), ("c", 2, "gut", "1", "0", "rating_fallback"), ("c", 3, "gut", "5", "1", "rating_fallback")],
        "bundle_id string, seq bigint, rep_review string, rating string, likes string, sentiment_method string")
    assert rows(gate.strength_state(bundles, cells)) == [("a", 1, "reported"), ("b", 0, "not_reported"), ("c", 2, "rejected")]
