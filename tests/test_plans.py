"""Physical plans: no all-pairs joins, limits before shuffles, pruned scans."""

import pytest
from conftest import FOLDER

from hearken.plans.catalog import QUERIES

# these run jobs while they are being built
EAGER = {
    "choose_k", "elbow_table", "kmeans_segments", "kmeans_properties", "pca_2d", "topics_lda",
    "lda_topic_terms", "topics_embedding", "stream_change_events", "stream_replay_guard",
    "stream_frame_reassembly", "ingest_checkpoint", "mart_load",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_all_pairs_join(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["dedup_first", "cap_per_query", "quotes_per_segment", "dedup_link"])
def test_group_limit_runs_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    final, partial = plan.find("WindowGroupLimit"), plan.rfind("WindowGroupLimit")
    assert "Exchange hashpartitioning" in plan[final:partial]
    assert "Partial" in plan[partial : partial + 400]


def test_ranking_reads_two_columns_and_shuffles_reviews_once(spark):
    plan = plan_of(QUERIES["pain_point_ranking"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert plan.count("FileScan parquet") == 1


def test_low_rating_columns_are_pruned(spark):
    plan = plan_of(QUERIES["sentiment_rating"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_text_expressions_stay_out_of_python(spark):
    for name in ("clean_text", "tfidf", "gate_ranges", "encode_survey", "replay_guard"):
        assert "Python" not in plan_of(QUERIES[name](spark, FOLDER))
