"""Queries on the gate and on the mart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.functions import hashing, text
from hearken.functions.numeric import to_number, to_whole
from hearken.operators import gate, mart, scoring, survey
from hearken.operators.cleaning import first_per_key, long_enough
from hearken.plans import reviews, surveys
from hearken.plans.registry import Inputs, query
from hearken.session import materialize
from hearken.session import scratch_dir

NUMBER = r"'^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


def num(cell: str) -> str:
    return f"(case when regexp_matches({cell}, {NUMBER}) then try_cast(trim({cell}) as double) end)"


def rules_sql(source: str, rules: dict[str, str], detail: str = "''") -> str:
    return " union all ".join(
        f"select bundle_id, {detail} as detail, '{code}' as rule from {source} where {bad}"
        for code, bad in rules.items()
    )


BLANK = "coalesce(trim({0}) = '', true)"


def blank(c: str) -> str:
    return BLANK.format(c)


# --- gate ------------------------------------------------------------------------------------


@query(
    "gate_presence",
    """with need as (select run_id as bundle_id, unnest(['reviews_raw.csv', 'reviews_clean.csv', 'painpoints.csv',
        'strengths.csv', 'metadata.json', 'preprocess_meta.json', 'painpoints_meta.json']) as name from v_runs)
       select bundle_id, name as detail, 'missing_file' as rule from need
       where (bundle_id, name) not in (select bundle_id, name from v_bundle_files)""",
)
def _(t: Inputs):
    return gate.presence(t.v_bundles, t.v_bundle_files)


_ANY_BLANK = f"({blank('collect_run')} or {blank('prep_run')} or {blank('pp_run')})"
RUN_ID_RULES = {
    "run_id_blank": _ANY_BLANK,
    "run_id_mismatch": f"not {_ANY_BLANK} and not (collect_run = prep_run and prep_run = pp_run)",
}
SOURCE_RULES = {
    "status_not_ok": "status is distinct from 'ok'",
    "source_not_real": "collect_source is distinct from 'google_play'",
    "preprocess_source_differs": "prep_source is distinct from collect_source",
    "painpoint_source_differs": "pp_source is distinct from collect_source",
    "demo_warning": "warning is not null",
    "app_id_missing": blank("app_id"),
}


@query("gate_run_id", rules_sql("v_bundles", RUN_ID_RULES))
def _(t: Inputs):
    return gate.run_ids(t.v_bundles)


@query("gate_source_chain", rules_sql("v_bundles", SOURCE_RULES))
def _(t: Inputs):
    return gate.source_chain(t.v_bundles)


_HASH, _ROW = reviews.sql_lanes("'=' || seq, coalesce('=' || {0}, '~')")
HASH_CTES = f"""rec as (select bundle_id, {_HASH} as recorded_hash
        from (select bundle_id, {_ROW.format('review')} as h from v_bundle_raw) group by bundle_id),
act as (select bundle_id, {_HASH} as actual_hash
        from (select bundle_id, {_ROW.format('review_now')} as h from v_bundle_raw) group by bundle_id)"""


def recorded(t: Inputs):
    return hashing.fingerprint(t.v_bundle_raw, ["seq", "review"], ["bundle_id"])


def current(t: Inputs):
    return t.v_bundle_raw.select("bundle_id", "seq", F.col("review_now").alias("review"))


STAGES = ("raw", "clean", "vectors", "report")
# what each stage holds, as it was recorded; from month 1 to 4 that stage was changed afterwards
STAGE_CELLS = {"raw": "review", "clean": "lower(review)", "vectors": "cast(length(review) as string)", "report": "substr(review, 1, 1)"}
STAGE_NOW = {
    stage: f"case when substr(bundle_id, 5, 2) = '0{i}' then concat({cell}, '!') else {cell} end"
    for i, (stage, cell) in enumerate(STAGE_CELLS.items(), 1)
}
# and these months have a stage that read another input, was never recorded, was not written or is not there at all
USED, RECORDED, WRITTEN, ABSENT = {"05": "clean"}, {"06": "vectors"}, {"07": "report"}, {"08": "vectors"}


def stage_rows(engine_hash: dict[str, tuple[str, str]]) -> str:
    """One row for each bundle and stage out of a table of hashes, in words both engines know."""
    month = "substr(bundle_id, 5, 2)"
    parts = []
    for i, stage in enumerate(STAGES):
        then, now = engine_hash[stage]

        def unless(cases: dict[str, str], value: str, other: str, stage=stage) -> str:
            hit = [f"{month} = '{m}'" for m, s in cases.items() if s == stage]
            return f"case when {hit[0]} then {other} else {value} end" if hit else value

        following = f"'{STAGES[i + 1]}'" if i + 1 < len(STAGES) else "cast(null as string)"
        absent = [m for m, s in ABSENT.items() if s == stage]
        where = f" where {month} <> '{absent[0]}'" if absent else ""
        parts.append(
            f"select bundle_id, '{stage}' as stage, {following} as next_stage, {unless(RECORDED, then, 'null')} as recorded_hash, "
            f"{unless(WRITTEN, now, 'null')} as actual_hash, {unless(USED, then, 'reverse(' + then + ')')} as used_hash from hashes{where}"
        )
    return " union all ".join(parts)


def stage_hashes() -> str:
    """The hashes of all stages, then and now, in one pass over the rows of DuckDB."""
    cells = {f"{s}_{w}": f"substr({c}, 1)" for w, of in (("then", STAGE_CELLS), ("now", STAGE_NOW)) for s, c in of.items()}
    digests, hashes = [], []
    for name, cell in cells.items():
        digests.append(f"sha256(concat_ws(chr(31), length(seq::varchar) || '=' || seq, coalesce(length({cell}) || '=' || {cell}, '~'))) as {name}")
        lanes = ", ".join(f"sum(cast(('0x' || substr({name}, {1 + 15 * i}, 15))::bigint as decimal(38,0)))::varchar" for i in range(4))
        hashes.append(f"sha256(concat_ws(',', count(*)::varchar, {lanes})) as {name}")
    return f"""digests as (select bundle_id, {', '.join(digests)} from v_bundle_raw),
        hashes as (select bundle_id, {', '.join(hashes)} from digests group by bundle_id)"""


@query(
    "gate_hash_chain",
    f"""with {stage_hashes()},
      links as ({stage_rows({s: (f'{s}_then', f'{s}_now') for s in STAGES})}),
      numbered as (select *, list_position(['raw', 'clean', 'vectors', 'report'], stage) as no,
          case when recorded_hash is null then 'not_recorded' when actual_hash is null then 'output_missing'
               when actual_hash <> recorded_hash then 'output_changed'
               when next_stage is not null and used_hash is distinct from recorded_hash then 'input_differs' end as broken from links),
      gaps as (select bundle_id, no + 1 as no, next_stage as stage, 'link_missing' as broken from numbered n where next_stage is not null
          and not exists (select 1 from links l where l.bundle_id = n.bundle_id and l.stage = n.next_stage)),
      found as (select bundle_id, no, stage, broken from numbered where broken is not null union all select * from gaps)
      select bundle_id, arg_min(stage, no) as detail, arg_min(broken, no) as rule from found group by bundle_id""",
)
def _(t: Inputs):
    cells = {f"{s}_{w}": F.expr(c) for w, of in (("then", STAGE_CELLS), ("now", STAGE_NOW)) for s, c in of.items()}
    rows = t.v_bundle_raw.select("bundle_id", "seq", *[c.alias(n) for n, c in cells.items()])
    prints = [hashing.fingerprint_of(F.col("seq"), F.col(n)).alias(n) for n in cells]
    hashes = rows.groupBy("bundle_id").agg(*prints)
    links = t.spark.sql(
        f"with hashes as (select * from {{stage_hashes}}) {stage_rows({s: (f'{s}_then', f'{s}_now') for s in STAGES})}",
        stage_hashes=materialize(hashes, "stage-hashes"),
    )
    return gate.walk_chain(links, t.v_bundle_raw.select("bundle_id").distinct(), STAGES[0])


@query(
    "gate_source_column",
    "with s as (select b.bundle_id, b.n_reviews, count(r.seq) as n_rows, "
    "count(*) filter (where r.source_type <> 'google_play') as n_foreign "
    "from v_bundles b left join v_bundle_raw r on r.bundle_id = b.bundle_id group by 1, 2) "
    + rules_sql(
        "s",
        {
            "no_rows": "n_rows = 0",
            "foreign_source_rows": "n_foreign > 0",
            "row_count_differs": "n_rows <> n_reviews",
        },
    ),
)
def _(t: Inputs):
    return gate.source_column(t.v_bundles, t.v_bundle_raw)


def outside(cell: str, low: int, high: int) -> str:
    return f"({num(cell)} is null or {num(cell)} < {low} or {num(cell)} > {high})"


def not_whole(cell: str, low: int) -> str:
    return f"({num(cell)} is null or floor({num(cell)}) <> {num(cell)} or {num(cell)} < {low})"


RANGE_RULES = {
    "freq_invalid": not_whole("freq", 1),
    "rating_invalid": outside("avg_rating", 1, 5),
    "mention_all_invalid": outside("mention_all_pct", 0, 100),
    "mention_assigned_invalid": outside("mention_assigned_pct", 0, 100),
    "quote_blank": blank("rep_review"),
}


@query("gate_ranges", rules_sql("v_painpoint_cells", RANGE_RULES, "'row ' || row_no"))
def _(t: Inputs):
    return gate.ranges(t.v_painpoint_cells)


RECONCILE = f"""cnt as (select run_id as bundle_id,
    cast(sum(freq) as bigint) + case when substr(run_id, 5, 2) = '11' then 1 else 0 end as negative_count,
    case when substr(run_id, 5, 2) = '12' then -1 else 0 end as noise_count
    from v_painpoints group by run_id),
rows_ as (select c.*, cnt.negative_count from v_painpoint_cells c join cnt on cnt.bundle_id = c.bundle_id),
sums as (select bundle_id, cast(sum(case when floor({num('freq')}) = {num('freq')} then {num('freq')} end) as bigint)
           as freq_sum from v_painpoint_cells group by bundle_id),
tot as (select cnt.*, sums.freq_sum from cnt left join sums on sums.bundle_id = cnt.bundle_id)
select bundle_id, 'row ' || row_no as detail, 'mention_not_reproducible' as rule from rows_
where negative_count >= 1 and abs({num('freq')} / negative_count * 100 - {num('mention_all_pct')}) > 0.1
union all """ + rules_sql(
    "tot",
    {
        "negative_count_invalid": "negative_count < 1",
        "noise_count_invalid": "noise_count < 0 or noise_count > negative_count",
        "freq_sum_differs": "freq_sum is distinct from negative_count - noise_count",
    },
)


def recorded_counts(t: Inputs):
    month = F.substring("run_id", 5, 2)
    counted = t.v_painpoints.groupBy("run_id").agg(F.sum("freq").alias("n"))
    return counted.select(
        F.col("run_id").alias("bundle_id"),
        (F.col("n") + F.when(month == "11", 1).otherwise(0)).alias("negative_count"),
        F.when(month == "12", -1).otherwise(0).alias("noise_count"),
    )


@query("gate_reconcile", f"with {RECONCILE}")
def _(t: Inputs):
    return gate.reconcile(t.v_painpoint_cells, recorded_counts(t))


STRENGTH_RULES = {
    "method_unknown": "sentiment_method not in ('rating_fallback', 'deep_learning')",
    "quote_blank": blank("rep_review"),
    "rating_outside_method": f"""(sentiment_method = 'rating_fallback' and {outside('rating', 4, 5)}
        or sentiment_method = 'deep_learning' and {outside('rating', 1, 5)})""",
    "likes_invalid": not_whole("likes", 0),
}


@query("gate_strengths", rules_sql("v_strength_cells", STRENGTH_RULES, "'row ' || seq"))
def _(t: Inputs):
    return gate.strengths(t.v_strength_cells)


STRENGTHS = f"""broken as (select distinct bundle_id from ({rules_sql('v_strength_cells', STRENGTH_RULES, "'row ' || seq")})),
  n as (select bundle_id, count(*) as n from v_strength_cells group by 1)"""


@query(
    "gate_strength_state",
    f"""with {STRENGTHS}, b as (select distinct source_type as bundle_id from v_reviews union all select bundle_id from v_bundles)
        select b.bundle_id, coalesce(n.n, 0) as n_strengths,
          case when broken.bundle_id is not null then 'rejected' when n.n is null then 'not_reported' else 'reported' end as state
        from b left join n on n.bundle_id = b.bundle_id left join broken on broken.bundle_id = b.bundle_id""",
)
def _(t: Inputs):
    """The bundles of months have no strength rows here."""
    bundles = t.v_reviews.select(F.col("source_type").alias("bundle_id")).distinct().unionByName(t.v_bundles.select("bundle_id"))
    return gate.strength_state(bundles, t.v_strength_cells)


@query(
    "gate_segments",
    rules_sql(
        "v_segment_manifests",
        {
            "source_unknown": "source_type not in ('survey', 'synthetic_demo')",
            "demo_not_allowed": "source_type = 'synthetic_demo'",
            "survey_hash_missing": f"source_type = 'survey' and {blank('survey_hash')}",
            "survey_hash_differs": f"""source_type = 'survey' and not {blank('survey_hash')}
                and survey_hash is distinct from actual_survey_hash""",
            "profile_hash_differs": "profile_hash is distinct from actual_profile_hash",
            "too_few_respondents": "n_respondents < 10",
        },
    ),
)
def _(t: Inputs):
    return gate.segment_manifest(t.v_segment_manifests)


@query(
    "gate_stage_guards",
    f"with {reviews.CLEAN_CTES}, "
    """g as (select source_type as bundle_id, count(*) as n_clean from uniq group by 1),
       k as (select source_type as bundle_id, count(*) as n_tokenised,
                    count(*) filter (where rating <= 3) as n_negative,
                    count(*) filter (where rating <= 3 and topic > 3) as n_assigned,
                    count(distinct topic) as n_patterns from clean group by 1),
       s as (select g.*, coalesce(n_tokenised, 0) as n_tokenised, coalesce(n_negative, 0) as n_negative,
                    coalesce(n_assigned, 0) as n_assigned, coalesce(n_patterns, 0) as n_patterns
             from g left join k on k.bundle_id = g.bundle_id) """
    + rules_sql(
        "s",
        {
            "too_few_clean": "n_clean < 3",
            "too_few_tokenised": "n_tokenised < 3",
            "too_few_negatives": "n_negative < 5",
            "all_noise": "n_negative > 0 and n_assigned = 0",
            "single_pattern": "n_patterns < 2",
        },
    ),
)
def _(t: Inputs):
    unique = first_per_key(long_enough(t.v_reviews), ["review"], ["seq"])
    has_tokens = F.size(text.tokens(F.col("review"), reviews.STOP)) > 0
    negative = has_tokens & (F.col("rating") <= 3)
    counts = unique.groupBy(F.col("source_type").alias("bundle_id")).agg(
        F.count(F.lit(1)).alias("n_clean"),
        F.count_if(has_tokens).alias("n_tokenised"),
        F.count_if(negative).alias("n_negative"),
        F.count_if(negative & (F.col("topic") > 3)).alias("n_assigned"),
        F.count_distinct(F.when(has_tokens, F.col("topic"))).alias("n_patterns"),
    )
    return gate.stage_guards(counts)


@query(
    "gate_first_valid",
    f"""with bad as ({rules_sql('v_bundles', RUN_ID_RULES)} union all {rules_sql('v_bundles', SOURCE_RULES)}
         union all {rules_sql('v_painpoint_cells', RANGE_RULES, "'row ' || row_no")}),
       r as (select bundle_id, count(*) as n from bad group by 1),
       j as (select b.grp, b.bundle_id, b.priority, r.n from v_bundles b left join r on r.bundle_id = b.bundle_id)
       select grp, min(bundle_id) filter (where n is null) as bundle_id,
              case when count(*) filter (where n is null) = 0 then 'hypothesis' else 'real' end as data_mode,
              count(*) filter (where n is not null) as n_rejected, cast(coalesce(sum(n), 0) as bigint) as n_reasons
       from j group by grp""",
)
def _(t: Inputs):
    found = gate.run_ids(t.v_bundles).unionByName(gate.source_chain(t.v_bundles))
    found = found.unionByName(gate.ranges(t.v_painpoint_cells))
    return gate.first_valid(t.v_bundles.select("grp", "bundle_id", "priority"), found)


@query(
    "gate_rejections",
    f"""with bad as ({rules_sql('v_bundles', RUN_ID_RULES)} union all {rules_sql('v_bundles', SOURCE_RULES)}
         union all {rules_sql('v_painpoint_cells', RANGE_RULES, "'row ' || row_no")}),
       ok as (select grp, min((priority, bundle_id)) as best from v_bundles b where not exists (select 1 from bad where bad.bundle_id = b.bundle_id) group by grp)
       select b.grp, b.bundle_id, b.priority, bad.rule, count(*) as n from v_bundles b join bad on bad.bundle_id = b.bundle_id
         left join ok on ok.grp = b.grp where ok.grp is null or (b.priority, b.bundle_id) < ok.best group by 1, 2, 3, 4""",
)
def _(t: Inputs):
    found = gate.run_ids(t.v_bundles).unionByName(gate.source_chain(t.v_bundles))
    found = found.unionByName(gate.ranges(t.v_painpoint_cells))
    return gate.rejections(t.v_bundles.select("grp", "bundle_id", "priority"), found)


@query(
    "gate_quote_source",
    f"""with {HASH_CTES},
    ok as (select b.bundle_id from v_bundles b join rec on rec.bundle_id = b.bundle_id
           join act on act.bundle_id = b.bundle_id
           where collect_source = 'google_play' and recorded_hash = actual_hash)
    select bundle_id, topic, rep_review from v_painpoint_cells where bundle_id in (select bundle_id from ok)
    qualify row_number() over (partition by bundle_id order by row_no) <= 3""",
)
def _(t: Inputs):
    was = recorded(t).select("bundle_id", F.col("content_hash").alias("recorded_hash"))
    now = hashing.fingerprint(current(t), ["seq", "review"], ["bundle_id"]).select(
        "bundle_id", F.col("content_hash").alias("actual_hash")
    )
    metas = t.v_bundles.join(was, "bundle_id").join(now, "bundle_id")
    return gate.trusted_quotes(metas, t.v_painpoint_cells)


# --- mart ------------------------------------------------------------------------------------


def runs(t: Inputs):
    return t.v_runs.withColumns(
        {
            "created_at": F.col("created_at").cast("timestamp"),
            "data_mode": F.lit("real"),
            "source_type": F.lit("google_play"),
        }
    )


def mart_points(t: Inputs):
    return t.v_mart_painpoints.withColumn("rep_review", F.lit(None).cast("string"))


@query(
    "mart_ddl",
    """select run_id, topic, cast(freq as int) as freq, cast(avg_rating as decimal(4,2)) as avg_rating,
       cast(mention_all_neg as decimal(5,1)) as mention_all_neg,
       cast(mention_assigned as decimal(5,1)) as mention_assigned, cast(null as varchar) as rep_review
       from v_mart_painpoints""",
)
def _(t: Inputs):
    return mart.conform(mart_points(t), "painpoints")


@query("mart_insert_run", "select run_id, gate_status from v_runs where gate_status = 'passed' and run_id >= '199500'")
def _(t: Inputs):
    existing = t.v_runs.filter(F.col("run_id") < "199500")
    return mart.new_runs(t.v_runs, existing).select("run_id", "gate_status")


def run_of(key: str):
    """Spreads rows without a run over the months of seven years."""
    year, month = F.lit(1992) + F.col(key) % 7, F.lpad((F.col(key) % 12 + 1).cast("string"), 2, "0")
    return F.concat(year.cast("string"), month)


def mart_tables(t: Inputs):
    """The landed tables under the names the pipeline gives them."""
    r = t.v_reviews.withColumns({"run_id": run_of("seq"), "date": F.col("review_date")})
    landed = r.select("run_id", "review", "rating", "date", "likes", "source_type", F.lower("review").alias("tokens"))
    members = survey.encode(surveys.answers(t)).withColumns(
        {"run_id": run_of("respondent_id"), "segment": F.col("respondent_id") % 4, "is_synthetic": F.lit(True)}
    )
    return {
        "painpoints": mart_points(t),
        "reviews": landed,
        "strengths": r.filter("rating = 5").select("run_id", "review", "rating", "likes"),
        "competitor_reviews": r.filter("app = 'rival'").select("run_id", "review", "rating", "date"),
        "segments": members,
        "testimony": t.v_hits.select(run_of("seq").alias("run_id"), F.col("markup").alias("text")),
    }


def _loaded(table: str, source: str, key: str | None = None, where: str = "true", cell: str = "run_id") -> str:
    run = "s.run_id" if key is None else f"cast(1992 + {key} % 7 as varchar) || lpad(cast({key} % 12 + 1 as varchar), 2, '0')"
    return f"""select '{table}' as table_name, count(*) as n_rows, count({cell}) as n_filled
        from (select {run} as run_id, s.* {"exclude (run_id)" if key is None else ""} from {source} s) p
        join (select run_id as passed from v_runs where gate_status = 'passed') on passed = run_id where {where}"""


# the cells counted are columns that the landed tables name differently
FILLED = {
    "painpoints": "mention_all_neg", "reviews": "review_date", "strengths": "rep_review",
    "competitor_reviews": "app", "segments": "app_freq", "testimony": "testimony",
}
LOADED = " union all ".join(
    [
        _loaded("painpoints", "v_mart_painpoints", cell="mention_all_neg"),
        _loaded("reviews", "v_reviews", "seq", cell="review_date"),
        _loaded("strengths", "v_reviews", "seq", "rating = 5", "review"),
        _loaded("competitor_reviews", "v_reviews", "seq", "app = 'rival'", "app"),
        _loaded("segments", f"({surveys.ENCODED})", "respondent_id", cell="app_frequency"),
        _loaded("testimony", "v_hits", "seq", cell="markup"),
        "select 'runs', count(*), count(*) from v_runs where gate_status = 'passed'",
    ]
)


@query("mart_load", LOADED)
def _(t: Inputs):
    base, tables = scratch_dir(t.spark, "mart"), mart_tables(t)
    mart.load(t.spark, base, runs(t), tables)
    counts = mart.load(t.spark, base, runs(t), tables)  # a second load changes nothing
    filled = [
        mart.read(t.spark, base, table).agg(F.count(cell).alias("n_filled")).withColumn("table_name", F.lit(table))
        for table, cell in {**FILLED, "runs": "run_id"}.items()
    ]
    return counts.join(reduce(DataFrame.unionByName, filled), "table_name")


@query(
    "mart_counts",
    """select 'runs' as table_name, count(*) as n_rows from v_runs union all
       select 'painpoints', count(*) from v_painpoints union all
       select 'reviews', count(*) from v_reviews""",
)
def _(t: Inputs):
    return mart.row_counts({"runs": t.v_runs, "painpoints": t.v_painpoints, "reviews": t.v_reviews})


@query(
    "dq_constraints",
    """select 'runs' as table_name, 'gate_not_passed' as rule, run_id as key, count(*) as n
       from v_runs where gate_status <> 'passed' group by run_id
       union all
       select 'painpoints', 'run_missing', run_id, count(*) from v_painpoints
       where run_id not in (select run_id from v_runs where gate_status = 'passed') group by run_id""",
)
def _(t: Inputs):
    passed = t.v_runs.filter(F.col("gate_status") == "passed")
    parent = mart.constraint_violations("runs", runs(t))
    child = mart.constraint_violations("painpoints", t.v_painpoints, runs=passed)
    return parent.unionByName(child)


@query(
    "dq_fk_orphans",
    """select run_id, topic, freq from v_painpoints
       where run_id not in (select run_id from v_runs where gate_status = 'passed')""",
)
def _(t: Inputs):
    passed = t.v_runs.filter(F.col("gate_status") == "passed")
    return mart.orphans(t.v_painpoints, passed).select("run_id", "topic", "freq")


LATEST = "(select max(run_id) from v_runs where gate_status = 'passed')"


@query("where_latest_passed", f"select run_id, topic, freq from v_painpoints where run_id = {LATEST}")
def _(t: Inputs):
    return mart.of_latest(t.v_painpoints, t.v_runs).select("run_id", "topic", "freq")


@query(
    "topk_painpoints",
    f"""select topic, freq, mention_all_neg, mention_assigned, avg_rating from v_mart_painpoints
        where run_id = {LATEST} order by mention_all_neg desc, topic limit 5""",
)
def _(t: Inputs):
    return mart.top_painpoints(t.v_mart_painpoints, t.v_runs)


@query("where_not_null", "select seq, review_date, rating from v_reviews where rating is not null")
def _(t: Inputs):
    return t.v_reviews.filter(F.col("rating").isNotNull()).select("seq", "review_date", "rating")


def _month(app: str) -> str:
    return f"""select cast(date_trunc('month', review_date) as date) as month, app,
        round_half(avg(rating), 2) as avg_rating, count(*) as n
        from v_reviews where app = '{app}' and review_date is not null group by 1, 2"""


@query("union_trend_q3", f"{_month('own')} union all {_month('rival')}")
def _(t: Inputs):
    r = t.v_reviews.select("app", "review_date", "rating")
    return mart.rating_trend(r.filter(F.col("app") == "own"), r.filter(F.col("app") == "rival"))


@query("like_topic_prefix", r"select run_id, topic from v_painpoints where topic like '1\_%' escape '\'")
def _(t: Inputs):
    return t.v_painpoints.filter(F.col("topic").like(r"1\_%")).select("run_id", "topic")


HISTORY = """select r.run_id, r.created_at, p.topic, p.mention_all_neg from v_runs r
    join v_mart_painpoints p on p.run_id = r.run_id where starts_with(p.topic, '1_')"""


@query("join_runs_painpoints", HISTORY)
def _(t: Inputs):
    return mart.run_history(t.v_runs, t.v_mart_painpoints, "1_")


@query(
    "run_drift",
    f"""with h as ({HISTORY}) select *, round_half(mention_all_neg
        - lag(mention_all_neg) over (partition by topic order by created_at, run_id), 1) as delta from h""",
)
def _(t: Inputs):
    return mart.with_drift(mart.run_history(t.v_runs, t.v_mart_painpoints, "1_"))


@query(
    "topk_head_rows",
    """select run_id, topic, freq, greatest((select count(*) from v_painpoints) - 12, 0) as omitted_n
       from v_painpoints order by run_id, topic limit 12""",
)
def _(t: Inputs):
    rows = t.v_painpoints.select("run_id", "topic", "freq")
    return mart.head_rows(rows, ["run_id", "topic"], 12)


AGENT_SQL = """select o_orderkey as run_id, '{"A":"' || case o_orderstatus when 'O' then 'success'
    when 'F' then 'failed' else 'skipped' end || '","B":"' || case when o_totalprice > 200000
    then 'success' else 'not_run' end || '","C":"success"}' as agent_results from orders"""


def agent_runs(t: Inputs):
    status = F.when(F.col("o_orderstatus") == "O", "success").when(
        F.col("o_orderstatus") == "F", "failed"
    )
    second = F.when(F.col("o_totalprice") > 200000, "success").otherwise("not_run")
    return t.orders.select(
        F.col("o_orderkey").alias("run_id"),
        F.to_json(
            F.struct(
                status.otherwise("skipped").alias("A"), second.alias("B"), F.lit("success").alias("C")
            )
        ).alias("agent_results"),
    )


@query("explode_agents", f"select run_id, unnest(json_keys(agent_results)) as agent from ({AGENT_SQL})")
def _(t: Inputs):
    return mart.agents(agent_runs(t)).select("run_id", "agent")


@query(
    "agg_agent_status",
    f"""with k as (select run_id, agent_results, unnest(json_keys(agent_results)) as agent from ({AGENT_SQL}))
        select run_id, json_extract_string(agent_results, '$.' || agent) as status, count(*) as n
        from k group by 1, 2""",
)
def _(t: Inputs):
    return mart.agent_status(agent_runs(t))


@query(
    "coerce_numeric",
    f"""select event_id, {num("json_extract_string(props, '$.k')")} as number,
        cast({num("event_type")} as double) as from_word,
        {num("cast(value as varchar)")} as from_value,
        cast(case when floor(value) = value then value end as bigint) as whole from events""",
)
def _(t: Inputs):
    return t.events.select(
        "event_id",
        to_number(F.get_json_object("props", "$.k")).alias("number"),
        to_number(F.col("event_type")).alias("from_word"),
        to_number(F.col("value")).alias("from_value"),
        to_whole(F.col("value")).alias("whole"),
    )


@query(
    "extract_json",
    """select event_id, try_cast(json_extract_string(regexp_extract('answer: ' || props || ' end', '(?s)\\{.*\\}', 0),
       '$.k') as double) as k from events""",
)
def _(t: Inputs):
    answer = F.concat(F.lit("answer: "), F.col("props"), F.lit(" end"))
    return t.events.select("event_id", to_number(F.try_element_at(scoring.answer_cells(answer), F.lit("k"))).alias("k"))
