"""Queries on readers and writers: tables are landed as files and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.functions.fixed_values import (
    PAINPOINT_HEADERS,
)
from hearken.operators import files, painpoints, vectors
from hearken.plans import models, reviews
from hearken.plans.registry import Inputs, query
from hearken.session import scratch_dir
from hearken.sources import readers, sinks, snapshots

ORIGINAL = """select review, rating, cast(review_date as timestamp) as date, likes, source_type from v_reviews"""


def review_columns(t: Inputs):
    return t.v_reviews.select(
        "review", "rating", F.col("review_date").cast("timestamp").alias("date"), "likes", "source_type"
    )


def same_reviews(df):
    return df.select("review", "rating", F.col("date").cast("timestamp_ntz").alias("date"), "likes", "source_type")


@query("src_reviews", ORIGINAL)
def _(t: Inputs):
    path = scratch_dir(t.spark, "reviews-csv")
    sinks.rows_csv(review_columns(t), path)
    return same_reviews(readers.reviews_csv(t.spark, path))


@query("src_app_alias", "select app, rating, cast(review_date as timestamp) as date, likes from v_reviews where app = 'own'")
def _(t: Inputs):
    path = scratch_dir(t.spark, "app-csv")
    mine = t.v_reviews.filter(F.col("app") == "own")
    sinks.rows_csv(
        mine.select("review", "rating", F.col("review_date").cast("timestamp").alias("date"), "likes", "source_type"),
        path,
    )
    own = readers.app_reviews(t.spark, path, "own")
    return own.select("app", "rating", F.col("date").cast("timestamp_ntz").alias("date"), "likes")


@query(
    "src_painpoints",
    f"""with {reviews.NEG_CTES} select cast(topic as varchar) as topic_label, cast(freq as varchar) as freq,
        try_cast(avg_rating as double) as avg_rating, mention_all_pct, mention_assigned_pct from pp""",
)
def _(t: Inputs):
    path = scratch_dir(t.spark, "painpoints-csv")
    points = painpoints.pain_points(reviews.negatives(t)).withColumnRenamed("topic", "topic_label")
    sinks.report_csv(points, path, PAINPOINT_HEADERS)
    cells = readers.painpoints_csv(t.spark, path)
    numbers = ["avg_rating", "mention_all_pct", "mention_assigned_pct"]
    return cells.select("topic_label", "freq", *[F.col(c).cast("double").alias(c) for c in numbers])


@query(
    "src_cx_scores",
    """with s as (select c_mktsegment as name, count(*) % 7 as a, count(*) % 5 as b, 3 as c, 4 as d, 5 as e
                  from customer group by 1)
       select name, axis, cast(score as double) as score, score between 1 and 5 as valid
       from (unpivot s on a, b, c, d, e into name axis value score)""",
)
def _(t: Inputs):
    path = scratch_dir(t.spark, "scores-csv")
    n = F.count(F.lit(1))
    sheet = t.customer.groupBy(F.col("c_mktsegment").alias("name")).agg(
        (n % 7).alias("a"), (n % 5).alias("b"), F.lit(3).alias("c"), F.lit(4).alias("d"), F.lit(5).alias("e")
    )
    sinks.rows_csv(sheet, path)
    return readers.cx_scores(t.spark, path)


@query(
    "src_meta_json",
    """select bundle_id as run_id, status, collect_source as source_type, warning, cast(n_reviews as int) as n_reviews
       from v_bundles""",
)
def _(t: Inputs):
    path = scratch_dir(t.spark, "metas")
    metas = t.v_bundles.select(
        F.col("bundle_id").alias("run_id"), "status", F.col("collect_source").alias("source_type"),
        "warning", F.col("n_reviews").cast("int").alias("n_reviews"),
    )
    # one file per run, as the collectors leave them
    metas.repartition("run_id").write.partitionBy("run_id").json(path)
    back = readers.lineage_metas(t.spark, path)
    return back.select("run_id", "status", "source_type", "warning", "n_reviews")


@query(
    "src_run_manifests",
    "select run_id, gate_status from v_runs where gate_status = 'passed' order by run_id desc limit 1",
)
def _(t: Inputs):
    path = scratch_dir(t.spark, "manifests")
    # every run has a manifest file of its own
    t.v_runs.select("run_id", "gate_status").write.option("maxRecordsPerFile", 1).json(path)
    return readers.newest_passed(readers.run_manifests(t.spark, path)).select("run_id", "gate_status")


@query(
    "src_search_pages",
    r"""select axis, origin, link, regexp_replace('' || ' ' || markup, '<[^>]+>', '', 'g') as review from v_hits""",
)
def _(t: Inputs):
    path = scratch_dir(t.spark, "search-pages")
    item = F.struct(F.lit("").alias("title"), F.col("markup").alias("description"), "link")
    t.v_hits.select("axis", "query", "origin", F.array(item).alias("items")).write.json(path)
    return readers.search_pages(t.spark, path).select("axis", "origin", "link", "review")


@query(
    "src_review_pages",
    """select review, rating, cast(review_date as timestamp) as date, likes from v_reviews
       qualify row_number() over (partition by review, review_date order by likes desc nulls last, rating nulls first) = 1""",
)
def _(t: Inputs):
    path = scratch_dir(t.spark, "review-pages")
    t.v_reviews.select(
        F.col("review").alias("content"), F.col("rating").alias("score"),
        F.col("review_date").cast("timestamp").alias("at"), F.col("likes").alias("thumbsUpCount"),
    ).write.json(path)
    newest = readers.review_pages(t.spark, path)
    return newest.withColumn("date", F.col("date").cast("timestamp_ntz"))


@query("sink_atomic", f"{ORIGINAL} where rating is not null")
def _(t: Inputs):
    path = scratch_dir(t.spark, "published")
    sinks.publish(review_columns(t), path, "r1")
    sinks.publish(review_columns(t).filter("rating is null"), path, "r2")
    sinks.publish(review_columns(t).filter("rating is not null"), path, "r1")  # replaces r1 only
    return same_reviews(sinks.of_run(t.spark, path, "r1"))


@query(
    "sink_snapshot",
    f"""select 'published' as step, review, rating, cast(review_date as timestamp) as date, likes, source_type from v_reviews where rating is not null
        union all select 'first', review, rating, cast(review_date as timestamp), likes, source_type from v_reviews where rating is null""",
)
def _(t: Inputs):
    """A step published twice, one published once, and one that had nothing to do this time."""
    path, every = scratch_dir(t.spark, "snapshots"), review_columns(t)
    steps = {
        "published": [lambda: every.filter("rating is null"), lambda: every.filter("rating is not null")],
        "first": [lambda: every.filter("rating is null")],
        "skipped": [lambda: every, lambda: None],
    }
    found = []
    for name, runs in steps.items():
        for i, step in enumerate(runs):
            snapshots.publish_step(step, f"{path}/{name}", f"r{i}")
        found.append(same_reviews(snapshots.current(t.spark, f"{path}/{name}", every.schema)).withColumn("step", F.lit(name)))
    return reduce(DataFrame.unionByName, found)


@query(
    "sink_meta",
    """select run_id, gate_status from v_runs union all select run_id, gate_status from v_runs where gate_status = 'failed'""",
)
def _(t: Inputs):
    path = scratch_dir(t.spark, "lineage")
    rows = t.v_runs.select("run_id", "gate_status")
    sinks.append_meta(rows, path)
    sinks.append_meta(rows.filter("gate_status = 'failed'"), path)
    return t.spark.read.parquet(path)


@query(
    "sink_tfidf",
    f"with {models.TERM_CTES} select term, count(*) as df from x group by term",
)
def _(t: Inputs):
    path = scratch_dir(t.spark, "weights")
    sinks.save_weights(models.weights(t), path)
    return t.spark.read.parquet(f"{path}/vocabulary")


# Reviews landed as text files of up to 500 documents by run and part; a file is named by its part.
FILE_CTES = """b as (select source_type as run_id, 'p' || (seq // 500) as name, coalesce(review, '') as line, seq from v_reviews),
  f as (select run_id, name, string_agg(line, chr(10) order by seq) || chr(10) as bytes from b group by all),
  h as (select run_id, name, cast(octet_length(encode(bytes)) as bigint) as length, sha256(encode(bytes)) as sha256, sha256(name) as k from f),
  leaf as (select run_id, k as node, sha256(k || ':' || sha256) as hash, 1 as n from h),
  n2 as (select run_id, substr(node, 1, 2) as node, sha256(string_agg(node || ':' || hash, ',' order by node)) as hash, sum(n) as n from leaf group by 1, 2),
  n1 as (select run_id, substr(node, 1, 1) as node, sha256(string_agg(node || ':' || hash, ',' order by node)) as hash, sum(n) as n from n2 group by 1, 2),
  n0 as (select run_id, '' as node, sha256(string_agg(node || ':' || hash, ',' order by node)) as hash, sum(n) as n from n1 group by 1)"""


def landed_texts(t: Inputs):
    path = scratch_dir(t.spark, "texts")
    part = F.concat(F.lit("p"), F.expr("cast(seq div 500 as string)"))
    lines = t.v_reviews.select("seq", F.coalesce("review", F.lit("")).alias("value"), F.col("source_type").alias("run_id"), part.alias("name"))
    # a part has 500 documents at most, so one task writes a file of bounded size
    ordered = lines.repartition("run_id", "name").sortWithinPartitions("run_id", "name", "seq")
    ordered.select("value", "run_id", "name").write.partitionBy("run_id", "name").text(path)
    return files.file_hashes(t.spark, path, "*.txt")


@query("content_hash_files", f"with {FILE_CTES} select run_id, name, length, sha256 from h")
def _(t: Inputs):
    return landed_texts(t).select("run_id", "name", "length", "sha256")


@query(
    "content_hash_tree",
    f"""with {FILE_CTES} select run_id, node, hash, cast(n as bigint) as n_files from n2
        union all select run_id, node, hash, cast(n as bigint) from n1 union all select run_id, node, hash, cast(n as bigint) from n0""",
)
def _(t: Inputs):
    return files.hash_tree(landed_texts(t), ["run_id"])
