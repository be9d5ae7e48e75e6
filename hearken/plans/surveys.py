"""Queries on the survey track: coding, segments, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearken.functions import survey as code
from hearken.functions.fixed_values import CODEBOOK, FEATURE_HEADERS
from hearken.functions.numeric import round_even
from hearken.operators import scoring, segments, survey
from hearken.plans import reviews
from hearken.plans.registry import Inputs, query
from hearken.session import scratch_dir
from hearken.sources import readers, sinks

NUMERIC = ["f1", "f2", "f3"]


def case(column: str, question: str) -> str:
    arms = " ".join(f"when '{a}' then cast({c} as double)" for a, c in CODEBOOK[question].items())
    return f"case {column} {arms} end"


def lead(column: str) -> str:
    return f"cast(nullif(regexp_extract({column}, '^\\s*([1-5])', 1), '') as double)"


ENCODED = f"""select respondent_id, {case('q1', 'q1')} as devices_owned, {case('q2', 'q2')} as app_frequency,
    {case('q3', 'q3')} as age_band,
    cast(coalesce(contains(q4, '자녀 있음'), false) as double) as has_child,
    {case('q5', 'q5')} as is_renter, {case('q6', 'q6')} as move_plan,
    cast(coalesce(contains(q7, '혼수'), false) as double) as wedding_purchase,
    {lead('q8')} as p1_experience, {lead('q9')} as p2_experience, {lead('q10')} as p3_burden,
    cast(len(list_filter(string_split(coalesce(q11_1, ''), ','), lambda x: trim(x) not in ('', '없음'))) > 0
         as double) as owns_watch,
    {lead('q11_2')} as night_use, {lead('q12')} as onbody_intent, {case('q13', 'q13')} as pay_intent,
    q5 as tenure_text, q11_3 as situation_text, q13_1 as worry_text, q13_2 as pricing_text, q15 as channel
    from v_survey_raw where q1 is distinct from '0대 (없음)'"""


def raw_export(t: Inputs):
    """The answers under the full-text headers a form export has."""
    headers = {
        "q1": "1. 보유 가전 수", "q2": "2. 앱 사용 빈도", "q3": "3. 연령대", "q4": "4. 가구 구성",
        "q5": "5. 주거 형태", "q6": "6. 이사 계획", "q7": "7. 구매 계기", "q8": "8. 연결 경험",
        "q9": "9. 재설정 경험", "q10": "10. 부담", "q11_1": "11-1. 워치", "q11_2": "11-2. 야간",
        "q11_3": "11-3. 상황", "q12": "12. 수용", "q13": "13. 지불", "q13_1": "13-1. 걱정",
        "q13_2": "13-2. 과금", "q15": "15. 경로",
    }
    return t.v_survey_raw.withColumnsRenamed(headers)


def answers(t: Inputs):
    return survey.without_screened_out(survey.with_question_names(raw_export(t)))


def landed_export(t: Inputs):
    """The form export written as CSV and read back, every cell text but the respondent's number."""
    raw, path = raw_export(t), scratch_dir(t.spark, "survey-csv")
    sinks.rows_csv(raw, path)
    number = F.col("respondent_id").cast(raw.schema["respondent_id"].dataType)
    return readers.survey_export(t.spark, path).withColumn("respondent_id", number)


@query("src_survey_raw", "select respondent_id, q1, q5, q13, q13_1 from v_survey_raw")
def _(t: Inputs):
    named = survey.with_question_names(landed_export(t))
    return named.select("respondent_id", "q1", "q5", "q13", "q13_1")


@query("filter_screened_out", "select respondent_id, q1 from v_survey_raw where q1 is distinct from '0대 (없음)'")
def _(t: Inputs):
    return answers(t).select("respondent_id", "q1")


@query("encode_scale", f"select respondent_id, cast({lead('scale_answer')} as int) as score from v_survey")
def _(t: Inputs):
    return t.v_survey.select("respondent_id", code.leading_scale(F.col("scale_answer")).alias("score"))


@query(
    "encode_keyword",
    """select respondent_id, cast(coalesce(contains(choice, 'MACH'), false) as int) as flag,
       cast(coalesce(contains(multi_answer, 'band'), false) as int) as band from v_survey""",
)
def _(t: Inputs):
    return t.v_survey.select(
        "respondent_id",
        code.has_keyword(F.col("choice"), "MACH").alias("flag"),
        code.has_keyword(F.col("multi_answer"), "band").alias("band"),
    )


@query(
    "encode_multiselect",
    """select respondent_id, cast(len(list_filter(string_split(coalesce(multi_answer, ''), ','),
       lambda x: trim(x) not in ('', 'none'))) > 0 as int) as owns from v_survey""",
)
def _(t: Inputs):
    return t.v_survey.select(
        "respondent_id", code.picked_any(F.col("multi_answer"), "none").alias("owns")
    )


@query("encode_survey", ENCODED)
def _(t: Inputs):
    return survey.encode(answers(t))


@query(
    "src_survey_coded",
    f"select respondent_id, {', '.join(FEATURE_HEADERS)} from ({ENCODED})",
)
def _(t: Inputs):
    landed = survey.without_screened_out(survey.with_question_names(landed_export(t)))
    return survey.encode(landed).select("respondent_id", *FEATURE_HEADERS)


@query(
    "join_codebook",
    " union all ".join(
        f"""select '{q}' as question, {q} as answer, count(*) as n from v_survey_raw
            where q1 is distinct from '0대 (없음)' and {q} is not null
            and {q} not in ({', '.join(f"'{a}'" for a in CODEBOOK[q])})
            group by {q}"""
        for q in ("q1", "q2", "q3", "q6", "q13")
    ),
)
def _(t: Inputs):
    return survey.unknown_answers(answers(t))


@query(
    "agg_tenure_loss",
    """with screened as (select * from v_survey_raw where q1 is distinct from '0대 (없음)'),
       lost as (select trim(q5) as answer, count(*) as n from screened
        where q5 is not null and q5 not in ('자가', '전세', '월세') group by 1),
       s as (select cast(sum(n) as bigint) as lost_n from lost), a as (select count(*) as total from screened)
       select answer, n, lost_n, round_half(cast(lost_n as double) / total * 100, 1) as lost_pct,
              cast(lost_n as double) / total * 100 >= 20 as alert from lost, s, a""",
)
def _(t: Inputs):
    return survey.tenure_loss(answers(t))


@query(
    "agg_missing_cells",
    f"select {' + '.join(f'count(*) filter (where {c} is null)' for c in FEATURE_HEADERS)} as missing_cells from ({ENCODED})",
)
def _(t: Inputs):
    return survey.missing_cells(survey.encode(answers(t)), list(FEATURE_HEADERS))


@query(
    "impute_median",
    f"""with e as ({ENCODED}) select respondent_id, {', '.join(
        f'coalesce({c}, (select median({c}) from e)) as {c}' for c in FEATURE_HEADERS)} from e""",
)
def _(t: Inputs):
    filled = segments.impute_median(survey.encode(answers(t)), list(FEATURE_HEADERS))
    return filled.select("respondent_id", *FEATURE_HEADERS)


@query(
    "impute_median_continuous",
    """select respondent_id, coalesce(f1, (select median(f1) from v_survey)) as f1, f2, f3 from v_survey""",
)
def _(t: Inputs):
    return segments.impute_median(t.v_survey, NUMERIC).select("respondent_id", *NUMERIC)


FILLED = """filled as (select respondent_id, segment, coalesce(f1, (select median(f1) from v_members)) as f1,
                             f2, f3 from v_members),
st as (select avg(f1) as m1, stddev_pop(f1) as s1, avg(f2) as m2, stddev_pop(f2) as s2,
              avg(f3) as m3, stddev_pop(f3) as s3 from filled),
z as (select respondent_id, segment, (f1 - m1) / nullif(s1, 0) as f1_z, (f2 - m2) / nullif(s2, 0) as f2_z,
             (f3 - m3) / nullif(s3, 0) as f3_z from filled, st)"""


def standardized(t: Inputs):
    return segments.standardize(segments.impute_median(t.v_members, NUMERIC), NUMERIC)


@query(
    "standardize",
    f"""with {FILLED} select respondent_id, round_half(coalesce(f1_z, 0), 6) as f1_z,
        round_half(coalesce(f2_z, 0), 6) as f2_z,
        round_half(coalesce(f3_z, 0), 6) as f3_z from z""",
)
def _(t: Inputs):
    z = standardized(t)
    return z.select("respondent_id", *[round_even(F.col(f"{c}_z"), 6).alias(f"{c}_z") for c in NUMERIC])


@query(
    "agg_segment_profile",
    f"""with {FILLED}, g as (select segment, count(*) as n, round_half(avg(f1), 2) as f1,
        round_half(avg(f2), 2) as f2,
        round_half(avg(f3), 2) as f3 from filled group by segment)
    select *, round_half(cast(n as double) / (select sum(n) from g) * 100, 1) as share_pct,
        'survey' as source_type from g""",
)
def _(t: Inputs):
    return segments.profile(segments.impute_median(t.v_members, NUMERIC), NUMERIC)


@query(
    "agg_segment_zprofile",
    f"""with {FILLED} select segment, count(*) as n, round_half(avg(f1_z), 2) as f1_z,
        round_half(avg(f2_z), 2) as f2_z,
        round_half(avg(f3_z), 2) as f3_z from z group by segment""",
)
def _(t: Inputs):
    z = segments.profile(standardized(t), [f"{c}_z" for c in NUMERIC])
    return z.drop("share_pct", "source_type")


@query("watermark_source", "select segment, count(*) as n, source_type from v_members group by segment, source_type")
def _(t: Inputs):
    """The members of either source profiled and stamped on their own."""
    parts = [
        segments.profile(t.v_members.filter(F.col("source_type") == s).drop("source_type"), NUMERIC, s) for s in ("survey", "synthetic_demo")
    ]
    return parts[0].unionByName(parts[1]).select("segment", "n", "source_type")


@query("agg_segment_sizes", "select label as segment, count(*) as n from embeddings group by label")
def _(t: Inputs):
    return segments.sizes(t.embeddings.withColumnRenamed("label", "segment"))


@query(
    "manifest_segments",
    """with g as (select segment, count(*) as n, count(*) filter (where f1 is null) as missing
                  from v_members group by segment)
       select cast(sum(n) as bigint) as n_respondents, cast(sum(missing) as bigint) as n_imputed_cells,
              count(*) as k, array_to_string(list_sort(list(segment || ':' || n)), ',') as segment_sizes from g""",
)
def _(t: Inputs):
    return segments.manifest(t.v_members, NUMERIC)


def lanes_of(cells: str, source: str) -> str:
    """The four-lane fingerprint of the rows of a table of DuckDB, as a scalar."""
    total, row = reviews.sql_lanes(cells)
    return f"(select {total} from (select {row} as h from {source}))"


def shown_cells(names: list[str]) -> str:
    whole = [f"cast(round_even({c} * 100, 0) as bigint)::varchar" for c in names]
    return ", ".join(f"coalesce(length({c}) || '=' || {c}, '~')" for c in ["segment::varchar", "n::varchar", *whole])


@query(
    "manifest_segments_run",
    f"""with {FILLED}, zz as (select respondent_id, segment, {', '.join(f'coalesce({c}_z, 0) as {c}_z' for c in NUMERIC)} from z),
       prof as (select segment, count(*) as n, {', '.join(f'round_half(avg({c}), 2) as {c}' for c in NUMERIC)} from filled group by 1),
       zprof as (select segment, count(*) as n, {', '.join(f'round_half(avg({c}_z), 2) as {c}_z' for c in NUMERIC)} from zz group by 1),
       p as (select *, f1_z * f1_z + f2_z * f2_z + f3_z * f3_z as q from zz),
       c as (select segment as s, cast(count(*) as double) as n, sum(q) as q, sum(f1_z) as a, sum(f2_z) as b, sum(f3_z) as d from p group by 1),
       far as (select respondent_id, min((p.q * n + c.q - 2 * (f1_z * a + f2_z * b + f3_z * d)) / n) filter (where s <> segment) as b,
          min(case when n > 1 then (p.q * n + c.q - 2 * (f1_z * a + f2_z * b + f3_z * d)) / (n - 1) end) filter (where s = segment) as a
          from p, c group by 1)
       select count(*) as n_respondents, count(*) filter (where f1 is null) as n_imputed_cells, (select count(*) from prof) as k,
         (select array_to_string(list_sort(list(segment || ':' || n)), ',') from prof) as segment_sizes,
         (select round_half(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 4) from far) as silhouette,
         {lanes_of("length(respondent_id::varchar) || '=' || respondent_id, length(segment::varchar) || '=' || segment", "v_members")} as seg_members_hash,
         {lanes_of(shown_cells(NUMERIC), "prof")} as seg_profile_hash,
         {lanes_of(shown_cells([c + "_z" for c in NUMERIC]), "zprof")} as seg_zprofile_hash, 'survey' as source_type from v_members""",
)
def _(t: Inputs):
    told = segments.publish_outputs(t.v_members, standardized(t), NUMERIC, scratch_dir(t.spark, "segments"), "s1", "survey")
    schema = (
        "n_respondents bigint, n_imputed_cells bigint, k bigint, segment_sizes string, silhouette double, "
        "seg_members_hash string, seg_profile_hash string, seg_zprofile_hash string, source_type string"
    )
    return t.spark.createDataFrame([told], schema)


@query(
    "quotes_per_segment",
    """select segment, respondent_id, trim(quote) as quote from v_members where length(trim(quote)) > 0
       qualify row_number() over (partition by segment order by respondent_id) <= 5""",
)
def _(t: Inputs):
    return segments.quotes(t.v_members)


@query(
    "share_of_total",
    """with g as (select segment, count(*) as n from v_members group by segment)
       select segment, n, round_half(cast(n as double) / (select sum(n) from g) * 100, 1) as share_pct from g""",
)
def _(t: Inputs):
    return scoring.shares(t.v_members, "segment")


@query(
    "agg_holdout_dist",
    """with g as (select segment, cast(round_even(onbody_intent, 0) as int) as category, count(*) as n,
        count(*) filter (where round_even(onbody_intent, 0) <> onbody_intent) as fractional_n
        from v_members where onbody_intent is not null group by 1, 2)
       select *, round_half(cast(n as double) / sum(n) over (partition by segment), 4) as share from g""",
)
def _(t: Inputs):
    return scoring.holdout_distribution(t.v_members, "onbody_intent")


@query(
    "agg_crosstab_h2",
    """select move_plan, is_renter, round_half(avg(onbody_intent), 2) as avg_intent, count(*) as n,
       bool_and(source_type = 'synthetic_demo') as all_synthetic
       from v_members group by move_plan, is_renter order by move_plan desc, is_renter desc""",
)
def _(t: Inputs):
    table = survey.crosstab_intent(t.v_members)
    return table.orderBy(F.desc("move_plan"), F.desc("is_renter"))


@query(
    "corr_h2",
    """select round_half(corr(is_renter, onbody_intent), 6) as is_renter__onbody_intent,
       round_half(corr(move_plan, onbody_intent), 6) as move_plan__onbody_intent,
       round_half(corr(is_renter, pay_intent), 6) as is_renter__pay_intent,
       round_half(corr(move_plan, pay_intent), 6) as move_plan__pay_intent from v_members""",
)
def _(t: Inputs):
    pairs = [(a, b) for b in ("onbody_intent", "pay_intent") for a in ("is_renter", "move_plan")]
    return survey.correlations(t.v_members, pairs)


# --- distribution scoring --------------------------------------------------------------------

DIST = """pred as (select trial, segment, category, weight / sum(weight) over (partition by trial, segment) as p
                 from v_predicted),
obs as (select segment, category, cast(n as double) / sum(n) over (partition by segment) as q from v_observed),
wanted as (select t.trial, o.segment, o.category, o.q from obs o
           join (select distinct trial, segment from v_predicted) t on t.segment = o.segment),
pairs as (select coalesce(p.trial, w.trial) as trial, coalesce(p.segment, w.segment) as segment,
                 coalesce(p.category, w.category) as category, coalesce(p, 0) as p, coalesce(q, 0) as q
          from pred p full join wanted w on w.trial = p.trial and w.segment = p.segment and w.category = p.category),
dist as (select trial, segment, round_half(sum(abs(p - q)) * 0.5, 6) as tvd from pairs group by 1, 2),
scored as (select trial, segment, tvd, round_half(1 - tvd, 4) as fidelity from dist)"""


def distribution_pairs(t: Inputs):
    predicted = scoring.normalized(t.v_predicted, ["trial", "segment"]).drop("weight")
    observed = scoring.normalized(t.v_observed, ["segment"], "n").withColumnRenamed("p", "q").drop("n")
    trials = t.v_predicted.select("trial", "segment").distinct()
    return scoring.aligned(predicted, trials.join(observed, "segment"), ["trial", "segment"])


@query(
    "dist_normalize",
    """select trial, segment, category, weight,
       round_half(weight / sum(weight) over (partition by trial, segment), 6) as p from v_predicted""",
)
def _(t: Inputs):
    scaled = scoring.normalized(t.v_predicted, ["trial", "segment"])
    return scaled.withColumn("p", round_even(F.col("p"), 6))


@query(
    "join_distributions",
    f"""with {DIST} select trial, segment, category, round_half(p, 6) as p,
        round_half(q, 6) as q from pairs""",
)
def _(t: Inputs):
    pairs = distribution_pairs(t)
    return pairs.withColumns({c: round_even(F.col(c), 6) for c in ("p", "q")})


@query("tvd", f"with {DIST} select * from scored")
def _(t: Inputs):
    return scoring.total_variation(distribution_pairs(t), ["trial", "segment"])


@query(
    "agg_fidelity",
    f"""with {DIST} select segment, count(fidelity) as n_trials, round_half(avg(fidelity), 4) as mean,
        round_half(stddev_samp(fidelity), 4) as sd from scored group by segment""",
)
def _(t: Inputs):
    scored = scoring.total_variation(distribution_pairs(t), ["trial", "segment"])
    return scoring.fidelity_summary(scored, "segment")


@query(
    "parse_distribution",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round_half(l_quantity / (l_quantity + l_linenumber), 6) as p1,
       round_half(l_linenumber / (l_quantity + l_linenumber), 6) as p2, cast(0 as double) as p3 from lineitem""",
)
def _(t: Inputs):
    text = F.concat(
        F.lit('I would say {"distribution": {"1": '), F.col("l_quantity").cast("string"),
        F.lit(', "2": '), F.col("l_linenumber").cast("string"), F.lit("}} overall"),
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    answered = t.lineitem.select(*keys, text.alias("answer"))
    parsed = scoring.parsed_answers(answered, "answer", (1, 2, 3))
    return parsed.select(
        *keys, *[round_even(F.col("distribution")[str(i)], 6).alias(f"p{i}") for i in (1, 2, 3)]
    )


CHECKS = """select cast(year(o_orderdate) as varchar) as run_id,
    case when l_linenumber <= 5 then 'B' else 'E' end as agent,
    case l_linenumber when 1 then 'quotes' when 2 then 'figures' when 3 then 'gate' when 4 then 'sources'
         when 5 then 'columns' when 6 then 'persona' else 'voc' end as item,
    l_returnflag <> 'A' as passed
    from lineitem join orders on o_orderkey = l_orderkey"""


@query(
    "scorecard",
    f"""with checks as ({CHECKS}),
    r as (select run_id, agent, item, cast(count(*) filter (where passed) as double) / count(*) as rate
          from checks group by 1, 2, 3),
    s as (select run_id,
        coalesce(max(rate) filter (where item = 'quotes'), 1) * 40 + coalesce(max(rate) filter (where item = 'figures'), 1) * 30
        + coalesce(max(rate) filter (where item = 'gate'), 1) * 15 + coalesce(max(rate) filter (where item = 'sources'), 1) * 10
        + coalesce(max(rate) filter (where item = 'columns'), 1) * 5 as b,
        coalesce(max(rate) filter (where item = 'persona'), 1) * 30 + 60
        + coalesce(max(rate) filter (where item = 'voc'), 1) * 10 as e from r group by run_id)
    select run_id, round_half(b, 2) as score_b, round_half(e, 2) as score_e,
        round_half((cast(0.4 as double) * e + cast(0.35 as double) * b) / cast(0.75 as double), 2) as score_total from s""",
)
def _(t: Inputs):
    lines = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    names = ["quotes", "figures", "gate", "sources", "columns", "persona", "voc"]
    item = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber"))
    checks = lines.select(
        F.year("o_orderdate").cast("string").alias("run_id"),
        F.when(F.col("l_linenumber") <= 5, "B").otherwise("E").alias("agent"),
        item.alias("item"),
        (F.col("l_returnflag") != "A").alias("passed"),
    )
    return scoring.scorecard(checks)
