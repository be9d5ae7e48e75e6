"""The lineage and data-quality gate: rules that turn tables into violation rows.

Every check works on any number of bundles at once and returns (bundle_id, rule, detail). A bundle
passes when no check returns a row for it. Details name rows and rules, never cell values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions import hashing
from hearken.functions.fixed_values import (
    DEMO_SOURCE,
    MENTION_TOLERANCE,
    MIN_DOCUMENTS,
    MIN_NEGATIVES,
    MIN_RESPONDENTS,
    REAL_SOURCE,
    REQUIRED_BUNDLE,
    STRENGTH_RATING_RANGE,
    SURVEY_SOURCE,
)
from hearken.functions.numeric import to_number, to_whole
from hearken.operators.cleaning import top_per_key
from hearken.session import materialize

Rules = dict[str, Column]


def broken_rules(df: DataFrame, rules: Rules, key: str = "bundle_id", detail: Column | None = None) -> DataFrame:
    """One row per broken rule; a rule is the condition under which it is broken."""
    hits = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items()])
    )
    shown = (detail if detail is not None else F.lit("")).alias("detail")
    return df.select(key, shown, F.explode(hits).alias("rule"))


def blank(cell: Column) -> Column:
    return F.coalesce(F.trim(cell) == "", F.lit(True))


def outside(value: Column, low: float, high: float | None) -> Column:
    """Missing, not a number, or outside the closed range."""
    number = to_number(value)
    bad = number.isNull() | (number < low)
    return bad if high is None else bad | (number > high)


def presence(bundles: DataFrame, files: DataFrame, required: tuple[str, ...] = REQUIRED_BUNDLE) -> DataFrame:
    """Required members a bundle lacks."""
    wanted = bundles.select(
        "bundle_id", F.explode(F.array(*[F.lit(n) for n in required])).alias("name")
    )
    missing = wanted.join(files, ["bundle_id", "name"], "left_anti")
    return missing.select("bundle_id", F.col("name").alias("detail"), F.lit("missing_file").alias("rule"))


def run_ids(metas: DataFrame) -> DataFrame:
    """Run ids must be non-blank and the same in all three metas."""
    three = [F.col(c) for c in ("collect_run", "prep_run", "pp_run")]
    any_blank = blank(three[0]) | blank(three[1]) | blank(three[2])
    same = (three[0] == three[1]) & (three[1] == three[2])
    return broken_rules(metas, {"run_id_blank": any_blank, "run_id_mismatch": ~any_blank & ~same})


def source_chain(metas: DataFrame, real: str = REAL_SOURCE) -> DataFrame:
    """Collection succeeded, the source is real and stays the same down the chain."""
    c = F.col
    return broken_rules(
        metas,
        {
            "status_not_ok": ~c("status").eqNullSafe("ok"),
            "source_not_real": ~c("collect_source").eqNullSafe(real),
            "preprocess_source_differs": ~c("prep_source").eqNullSafe(c("collect_source")),
            "painpoint_source_differs": ~c("pp_source").eqNullSafe(c("collect_source")),
            "demo_warning": c("warning").isNotNull(),
            "app_id_missing": blank(c("app_id")),
        },
    )


def hash_chain(recorded: DataFrame, table: DataFrame, columns: list[str], rule: str) -> DataFrame:
    """Recorded content hash against the hash of the table as it is now, per bundle."""
    actual = hashing.fingerprint(table, columns, ["bundle_id"]).select(
        "bundle_id", F.col("content_hash").alias("actual_hash")
    )
    checked = recorded.join(actual, "bundle_id", "left")
    return broken_rules(checked, {rule: ~F.col("content_hash").eqNullSafe(F.col("actual_hash"))})


WALK = """
with recursive walk(bundle_id, stage, next_stage, broken, step) as (
  select bundle_id, stage, next_stage, broken, 1 from {links} where stage = {first}
  union all
  select w.bundle_id, w.next_stage, l.next_stage,
         case when w.step >= {most} then 'chain_in_circles' when l.stage is null then 'link_missing' else l.broken end, w.step + 1
  from walk w left join {links} l on l.bundle_id = w.bundle_id and l.stage = w.next_stage
  where w.broken is null and w.next_stage is not null
)
select bundle_id, stage as detail, broken as rule from walk where broken is not null
"""
MOST_STAGES = 32


def walk_chain(links: DataFrame, bundles: DataFrame, first: str, most: int = MOST_STAGES) -> DataFrame:
    """The first broken link of every bundle, walking from the stage `first` along `next_stage`.

    `links` has a row for each stage of a bundle: `recorded_hash` when the stage was written, `actual_hash` of its output as it
    is now, and `used_hash`, which the next stage recorded as its input (NULL for the last stage). A bundle without the
    first stage, a stage that nothing follows although the one before names it, and a chain of more than `most` stages
    are broken too. Links are written first, since each step of the walk reads them. Spark limits a recursion to
    `spark.sql.cteRecursionRowLimit` rows; beyond so many bundles that setting has to be raised, or the walk fails.
    """
    recorded, actual, used = (F.col(c) for c in ("recorded_hash", "actual_hash", "used_hash"))
    broken = (
        F.when(blank(recorded), "not_recorded")
        .when(actual.isNull(), "output_missing")
        .when(actual != recorded, "output_changed")
        .when(F.col("next_stage").isNotNull() & ~used.eqNullSafe(recorded), "input_differs")
    )
    judged = materialize(links.select("bundle_id", "stage", "next_stage", broken.alias("broken")), "chain-links")
    walked = links.sparkSession.sql(WALK, links=judged, first=first, most=most)
    never = bundles.join(judged.filter(F.col("stage") == first), "bundle_id", "left_anti")
    return walked.unionByName(never.select("bundle_id", F.lit(first).alias("detail"), F.lit("link_missing").alias("rule")))


def source_column(metas: DataFrame, table: DataFrame, real: str = REAL_SOURCE) -> DataFrame:
    """Every row carries the one expected source, and the row count is the recorded one."""
    seen = table.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("source_type").eqNullSafe(real)).alias("n_foreign"),
    )
    checked = metas.join(seen, "bundle_id", "left")
    return broken_rules(
        checked,
        {
            "no_rows": F.col("n_rows").isNull(),
            "foreign_source_rows": F.col("n_foreign") > 0,
            "row_count_differs": F.col("n_rows") != F.col("n_reviews"),
        },
    )


def ranges(cells: DataFrame) -> DataFrame:
    """Cell rules of the pain-point table, with the row number."""
    freq = to_whole(F.col("freq"))
    return broken_rules(
        cells,
        {
            "freq_invalid": freq.isNull() | (freq < 1),
            "rating_invalid": outside(F.col("avg_rating"), 1, 5),
            "mention_all_invalid": outside(F.col("mention_all_pct"), 0, 100),
            "mention_assigned_invalid": outside(F.col("mention_assigned_pct"), 0, 100),
            "quote_blank": blank(F.col("rep_review")),
        },
        detail=F.concat(F.lit("row "), F.col("row_no").cast("string")),
    )


def reconcile(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Frequencies add up to negatives minus noise, and every mention share can be recomputed."""
    known = cells.join(counts, "bundle_id")
    negative = F.col("negative_count").cast("double")
    expected = to_number(F.col("freq")) / negative * F.lit(100.0)
    off = F.abs(expected - to_number(F.col("mention_all_pct"))) > MENTION_TOLERANCE
    per_row = broken_rules(
        known,
        {"mention_not_reproducible": (negative >= 1) & off},
        detail=F.concat(F.lit("row "), F.col("row_no").cast("string")),
    )
    sums = cells.groupBy("bundle_id").agg(F.sum(to_whole(F.col("freq"))).alias("freq_sum"))
    totals = counts.join(sums, "bundle_id", "left")
    noise, neg = F.col("noise_count"), F.col("negative_count")
    per_bundle = broken_rules(
        totals,
        {
            "negative_count_invalid": neg.isNull() | (neg < 1),
            "noise_count_invalid": noise.isNull() | (noise < 0) | (noise > neg),
            "freq_sum_differs": ~F.col("freq_sum").eqNullSafe(neg - noise),
        },
    )
    return per_row.unionByName(per_bundle)


def strengths(cells: DataFrame) -> DataFrame:
    """Cell rules of the strength table; the allowed ratings depend on the sentiment method."""
    method = F.col("sentiment_method")
    known = method.isin(list(STRENGTH_RATING_RANGE))
    bad_rating = F.lit(False)
    for name, (low, high) in STRENGTH_RATING_RANGE.items():
        bad_rating = F.when(method == name, outside(F.col("rating"), low, high)).otherwise(bad_rating)
    likes = to_whole(F.col("likes"))
    return broken_rules(
        cells,
        {
            "method_unknown": ~known,
            "quote_blank": blank(F.col("rep_review")),
            "rating_outside_method": bad_rating,
            "likes_invalid": likes.isNull() | (likes < 0),
        },
        detail=F.concat(F.lit("row "), F.col("seq").cast("string")),
    )


def segment_manifest(manifests: DataFrame, allow_demo: bool = False) -> DataFrame:
    """Known source, matching hashes and enough respondents."""
    c = F.col
    survey = c("source_type") == SURVEY_SOURCE
    return broken_rules(
        manifests,
        {
            "source_unknown": ~F.coalesce(c("source_type").isin(SURVEY_SOURCE, DEMO_SOURCE), F.lit(False)),
            "demo_not_allowed": (c("source_type") == DEMO_SOURCE) & F.lit(not allow_demo),
            "survey_hash_missing": survey & blank(c("survey_hash")),
            "survey_hash_differs": survey
            & ~blank(c("survey_hash"))
            & ~c("survey_hash").eqNullSafe(c("actual_survey_hash")),
            "profile_hash_differs": ~c("profile_hash").eqNullSafe(c("actual_profile_hash")),
            "too_few_respondents": c("n_respondents").isNull() | (c("n_respondents") < MIN_RESPONDENTS),
        },
    )


def stage_guards(counts: DataFrame) -> DataFrame:
    """Minimum sizes between the stages."""
    c = F.col
    return broken_rules(
        counts,
        {
            "too_few_clean": c("n_clean") < MIN_DOCUMENTS,
            "too_few_tokenised": c("n_tokenised") < MIN_DOCUMENTS,
            "too_few_negatives": c("n_negative") < MIN_NEGATIVES,
            "all_noise": (c("n_negative") > 0) & (c("n_assigned") == 0),
            "single_pattern": c("n_patterns") < 2,
        },
    )


def first_valid(candidates: DataFrame, violations: DataFrame) -> DataFrame:
    """Per group the first candidate without violations; none means hypothesis mode.

    Violations are counted per bundle before the join, so a bundle with many broken cells does
    not multiply.
    """
    reasons = violations.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_reasons"))
    judged = candidates.join(reasons, "bundle_id", "left").withColumn(
        "passed", F.col("n_reasons").isNull()
    )
    first = F.min(F.when(F.col("passed"), F.struct("priority", "bundle_id")))
    failed_at = F.when(~F.col("passed"), F.col("priority"))
    chosen = judged.groupBy("grp").agg(
        first.alias("first"),
        F.count(failed_at).alias("n_rejected"),
        F.sum("n_reasons").alias("n_reasons"),
    )
    return chosen.select(
        "grp",
        F.col("first.bundle_id").alias("bundle_id"),
        F.when(F.col("first").isNull(), "hypothesis").otherwise("real").alias("data_mode"),
        "n_rejected",
        F.coalesce("n_reasons", F.lit(0)).alias("n_reasons"),
    )


def rejections(candidates: DataFrame, violations: DataFrame) -> DataFrame:
    """(grp, bundle_id, priority, rule, n): why each candidate was passed over that came before the one chosen.

    Where no candidate is valid these are all of the group. Violations are counted by rule first, so there is one row for
    each broken rule of a bundle, however many cells break it.
    """
    counted = violations.groupBy("bundle_id", "rule").agg(F.count(F.lit(1)).alias("n"))
    chosen = first_valid(candidates, violations).select("grp", F.col("bundle_id").alias("_chosen"))
    at = candidates.join(chosen, "grp").filter(F.col("bundle_id") == F.col("_chosen")).select("grp", F.struct("priority", "bundle_id").alias("_at"))
    before = candidates.join(at, "grp", "left").filter(F.col("_at").isNull() | (F.struct("priority", "bundle_id") < F.col("_at")))
    return before.join(counted, "bundle_id").select("grp", "bundle_id", "priority", "rule", "n")


def strength_state(bundles: DataFrame, cells: DataFrame) -> DataFrame:
    """(bundle_id, n_strengths, state): `rejected` if a row breaks a rule, `reported`, or `not_reported` for a table without rows.

    A bundle without strengths stays valid; its report just says that none were found.
    """
    counts = cells.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_strengths"))
    broken = strengths(cells).select("bundle_id").distinct().withColumn("_broken", F.lit(True))
    told = bundles.select("bundle_id").join(counts, "bundle_id", "left").join(broken, "bundle_id", "left")
    n = F.coalesce("n_strengths", F.lit(0))
    state = F.when(F.col("_broken"), "rejected").when(n == 0, "not_reported").otherwise("reported")
    return told.select("bundle_id", n.alias("n_strengths"), state.alias("state"))


def trusted_quotes(metas: DataFrame, quotes: DataFrame, n: int = 3) -> DataFrame:
    """The first quotes of bundles whose meta exists, names a real source and matches the content."""
    trusted = metas.filter(
        (F.col("collect_source") == REAL_SOURCE) & (F.col("recorded_hash") == F.col("actual_hash"))
    ).select("bundle_id")
    known = quotes.join(trusted, "bundle_id", "left_semi")
    return top_per_key(known, ["bundle_id"], ["row_no"], n).select("bundle_id", "topic", "rep_review")
