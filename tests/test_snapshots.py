"""Snapshots behind a pointer: readers see whole tables of the latest run, or none."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hearken.operators import compare, search, segments
from hearken.sources import snapshots

SCHEMA = "id bigint, name string"


def table(spark, n, start=0):
    return spark.range(start, start + n, numPartitions=4).select("id", F.concat(F.lit("n"), "id").alias("name"))


def test_a_publication_replaces_the_table_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.publish(table(spark, 10), path, "r1")
    old = snapshots.current(spark, path, SCHEMA)
    snapshots.publish(table(spark, 5, 100), path, "r2")
    assert rows(snapshots.current(spark, path, SCHEMA)) == [(100 + i, f"n{100 + i}") for i in range(5)]
    assert old.count() == 10  # a reader that had begun keeps its files
    told = snapshots.pointer(spark, path).first()
    assert (told["run_id"], told["n_rows"], told["withdrawn"]) == ("r2", 5, None)
    assert snapshots.remove_old(path) == 1 and snapshots.remove_old(path) == 0
    assert snapshots.current(spark, path, SCHEMA).count() == 5


def test_a_failing_task_leaves_readers_on_the_old_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.publish(table(spark, 10), path, "r1")
    broken = table(spark, 10).withColumn("name", F.when(F.col("id") == 7, F.raise_error(F.lit("broken row"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken row"):
        snapshots.publish(broken, path, "r2")
    assert rows(snapshots.current(spark, path, SCHEMA)) == rows(table(spark, 10))
    assert snapshots.pointer(spark, path).first()["run_id"] == "r1"
    assert len([n for n in os.listdir(path) if os.path.isdir(f"{path}/{n}")]) == 1  # nothing of the failed job is left


def test_a_skipped_or_failed_step_leaves_no_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snapshots.publish_step(lambda: table(spark, 3), path, "r1") == "published"
    assert snapshots.publish_step(lambda: None, path, "r2") == "skipped"
    assert rows(snapshots.current(spark, path, SCHEMA)) == []
    assert snapshots.pointer(spark, path).first()["withdrawn"] == "skipped"
    snapshots.publish_step(lambda: table(spark, 3), path, "r3")
    with pytest.raises(ZeroDivisionError):
        snapshots.publish_step(lambda: 1 / 0, path, "r4")
    assert snapshots.current(spark, path, SCHEMA).count() == 0
    assert snapshots.pointer(spark, path).first()["withdrawn"] == "failed"


def test_empty_tables_are_published(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    snapshots.publish(table(spark, 0), path, "r1")
    assert snapshots.current(spark, path, SCHEMA).count() == 0
    assert snapshots.pointer(spark, path).first()["withdrawn"] is None


def test_metrics_come_from_the_pass_that_writes(spark, tmp_path):
    data = [(1, "a", 1, "2024-01-02"), (2, None, None, "2024-01-01"), (3, "b", 9, "2024-03-01"), (4, "c", 1, None)]
    df = spark.createDataFrame(data, "seq bigint, review string, rating int, day string").withColumn("day", F.to_date("day"))
    told = snapshots.observed(df, str(tmp_path / "crawl"), "r", compare.crawl_metrics("day"))
    assert told["n_reviews"] == 4 and str(told["first_date"]) == "2024-01-01" and str(told["last_date"]) == "2024-03-01"
    assert told["rating_dist"] == "1:2,none:1,other:1"
    again = snapshots.observed(df.repartition(3), str(tmp_path / "crawl2"), "r", compare.crawl_metrics("day"))
    other = snapshots.observed(df.filter("seq <> 4"), str(tmp_path / "crawl3"), "r", compare.crawl_metrics("day"))
    assert told["content_hash"] == again["content_hash"] != other["content_hash"]
    none = snapshots.observed(df.limit(0), str(tmp_path / "crawl4"), "r", compare.crawl_metrics("day"))
    assert none["n_reviews"] == 0 and none["rating_dist"] == ""


def test_axis_yield_of_a_search(spark, tmp_path):
    data = [(i, "r", "A" if i < 4 else "B", i % 4 == 0, i == 5) for i in range(10)]
    df = spark.createDataFrame(data, "seq bigint, review string, axis string, valid boolean, sponsored boolean")
    told = snapshots.observed(df, str(tmp_path / "s"), "r", search.search_metrics(["A", "B", "C"], threshold=25.0))
    assert (told["axis_yield"], told["adopted"], told["sponsored_rows"]) == ("A:4:1,B:6:2", "A,B", 1)
    told = snapshots.observed(df, str(tmp_path / "s2"), "r", search.search_metrics(["A", "B", "C"], threshold=30.0))
    assert told["adopted"] == "B"


def test_silhouette_equals_the_plain_one(spark):
    points = [(0, 0.0, 0.0), (0, 1.0, 0.5), (0, 0.5, 1.5), (1, 9.0, 9.0), (1, 8.0, 9.5), (2, 4.0, -3.0)]
    df = spark.createDataFrame(points, "segment int, x double, y double")

    def d(p, q):
        return (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2

    def mean(values):
        values = list(values)
        return sum(values) / len(values) if values else None

    widths = []
    for p in points:
        a = mean(d(p, q) for q in points if q[0] == p[0] and q is not p)
        b = min(mean(d(p, q) for q in points if q[0] == s) for s in {q[0] for q in points} - {p[0]})
        widths.append(0.0 if a is None else (b - a) / max(a, b))
    assert abs(segments.silhouette(df, ["x", "y"]).first()[0] - mean(widths)) < 1e-12
    assert segments.silhouette(df.filter("segment = 0"), ["x", "y"]).first()[0] == 0.0
