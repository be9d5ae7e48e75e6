"""Views that give the shared test tables the shapes the operators expect.

Every view is one SQL text that Spark and DuckDB both run, so a query and its twin start from the
same rows. `{name}` stands for a table or for another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # reviews: one row per document; topic -1 is noise
    "v_reviews": """
        select doc_id as seq, text as review,
               cast(case when doc_id % 23 = 0 then null else (doc_id * 7) % 5 + 1 end as int) as rating,
               cast(date '2024-01-01' + cast((doc_id * 37) % 730 as int) as date) as review_date,
               cast(n_chars % 50 as int) as likes, source as source_type, lang as axis,
               case when doc_id % 3 = 0 then 'own' else 'rival' end as app,
               cast((doc_id * 11) % 7 - 1 as int) as topic,
               cast((doc_id * 13) % 97 as double) / 97 as topic_prob
        from {documents}""",
    "v_labelled": """
        select r.seq, r.review, r.rating, r.source_type,
               concat('LABEL_', cast(l.quality as string)) as model_label,
               concat('LABEL_', cast(l.quality + 2 * l.toxic as string)) as loose_label
        from {v_reviews} r join {labels} l on l.doc_id = r.seq""",
    # search hits: one row per landed page
    "v_hits": """
        select page_id as seq, html as markup, url as link,
               regexp_extract(url, '/(en|fr|de|es)/', 1) as axis,
               regexp_extract(url, '/(en|fr|de|es)/', 1) as query,
               regexp_extract(url, '^https?://([^/]+)/', 1) as origin
        from {pages}""",
    # ratings of five apps over one month
    "v_ratings": """
        select event_id as seq, event_type as app,
               cast(least(5, floor(value / 100) + 1) as int) as rating, ts, user_id
        from {events}""",
    "v_survey": """
        select c.c_custkey as respondent_id, c.c_mktsegment as choice,
               case when c.c_custkey % 17 = 0 then null else c.c_acctbal end as f1,
               cast(count(o.o_orderkey) as double) as f2, cast(c.c_nationkey as double) as f3,
               concat(cast(c.c_custkey % 7 as string), ' often') as scale_answer,
               case when c.c_custkey % 4 = 0 then 'none' when c.c_custkey % 4 = 1 then 'watch, band'
                    when c.c_custkey % 4 = 2 then '' else null end as multi_answer
        from {customer} c left join {orders} o on o.o_custkey = c.c_custkey
        group by c.c_custkey, c.c_mktsegment, c.c_acctbal, c.c_nationkey""",
    # the same customers as raw questionnaire answers
    "v_survey_raw": """
        select c_custkey as respondent_id,
               case c_custkey % 6 when 0 then '0대 (없음)' when 1 then '1대' when 2 then '2~3대'
                    when 3 then '4대 이상' when 4 then '모름' else null end as q1,
               case c_nationkey % 6 when 0 then '사용해본 적 없음' when 1 then '설치만 해둠'
                    when 2 then '월 1회 이하' when 3 then '주 1~2회' when 4 then '거의 매일'
                    else '가끔' end as q2,
               case c_custkey % 5 when 0 then '20대 이하' when 1 then '30대' when 2 then '40대'
                    when 3 then '50대' else '60대 이상' end as q3,
               case c_nationkey % 3 when 0 then '부부, 자녀 있음' when 1 then '1인 가구' else null end as q4,
               case c_custkey % 7 when 0 then '자가' when 1 then '전세' when 2 then '월세'
                    when 3 then ' 관사 ' when 4 then '관사' when 5 then null else '자가' end as q5,
               case c_nationkey % 4 when 0 then '있다' when 1 then '없다' when 2 then '아직 모르겠다'
                    else null end as q6,
               case c_custkey % 4 when 0 then '혼수 장만' when 1 then '이사' else null end as q7,
               concat(' ', cast(c_custkey % 12 as string), ' 자주') as q8,
               concat(cast(c_nationkey % 7 as string), ' 가끔') as q9,
               case when c_custkey % 9 = 0 then null else cast(c_custkey % 6 as string) end as q10,
               case c_custkey % 5 when 0 then '없음' when 1 then '애플워치, 가민' when 2 then ''
                    when 3 then null else '없음, 가민' end as q11_1,
               concat(cast(c_custkey % 6 as string), ' 점') as q11_2,
               case when c_custkey % 8 = 0 then ' ' else c_name end as q11_3,
               concat(cast(c_nationkey % 6 as string), ' 점') as q12,
               case c_custkey % 4 when 0 then '무료가 아니면 쓰지 않겠다'
                    when 1 then '무료로 써보고 괜찮으면 유료도 고려하겠다'
                    when 2 then '유료라도 쓸 의향이 있다' else '글쎄' end as q13,
               c_mktsegment as q13_1, cast(null as string) as q13_2, c_mktsegment as q15
        from {customer}""",
    # respondents with a segment and the two held-out answers
    "v_members": """
        select s.respondent_id, cast(c.c_nationkey % 4 as int) as segment, s.f1, s.f2, s.f3,
               case when s.respondent_id % 11 = 0 then null
                    else cast(s.respondent_id % 9 + 2 as double) / 2 end as onbody_intent,
               cast(s.respondent_id % 3 as double) as pay_intent,
               cast(s.respondent_id % 2 as int) as is_renter,
               cast(s.respondent_id % 3 as double) / 2 as move_plan,
               case when s.respondent_id % 5 = 0 then ' ' else concat(' ', c.c_name) end as quote,
               case when c.c_nationkey = 3 then 'synthetic_demo' else 'survey' end as source_type
        from {v_survey} s join {customer} c on c.c_custkey = s.respondent_id""",
    # one run per order month, with its topic table
    "v_runs": """
        select cast(year(o_orderdate) * 100 + month(o_orderdate) as string) as run_id,
               cast(min(o_orderdate) as date) as created_at,
               case when month(min(o_orderdate)) % 3 = 0 then 'failed' else 'passed' end as gate_status,
               count(*) as n_orders
        from {orders} group by year(o_orderdate) * 100 + month(o_orderdate)""",
    "v_painpoints": """
        select cast(year(o.o_orderdate) * 100 + month(o.o_orderdate) as string) as run_id,
               concat(cast(l.l_linenumber as string), '_', l.l_returnflag) as topic,
               count(*) as freq, sum(cast(l.l_quantity as decimal(18,2))) as qty,
               sum(cast(l.l_linenumber % 5 + 1 as bigint)) as rating_sum
        from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey
        group by year(o.o_orderdate) * 100 + month(o.o_orderdate), l.l_linenumber, l.l_returnflag""",
    "v_mart_painpoints": """
        select p.run_id, p.topic, p.freq,
               round_half(cast(p.rating_sum as double) / p.freq, 2) as avg_rating,
               round_half(cast(p.freq as double) / t.n * 100, 1) as mention_all_neg,
               round_half(cast(p.freq as double) / t.n * 100, 1) as mention_assigned
        from {v_painpoints} p
        join (select run_id, sum(freq) as n from {v_painpoints} group by run_id) t
          on t.run_id = p.run_id""",
    # bundles of one run each, some of them with one defect
    "v_bundles": """
        select run_id as bundle_id, substr(run_id, 1, 4) as grp, cast(substr(run_id, 5, 2) as int) as priority,
               run_id as collect_run,
               case when substr(run_id, 5, 2) = '02' then concat(run_id, 'x')
                    when substr(run_id, 5, 2) = '03' then ' ' else run_id end as prep_run,
               run_id as pp_run,
               case when substr(run_id, 5, 2) = '05' then 'failed' else 'ok' end as status,
               case when substr(run_id, 5, 2) = '06' then 'synthetic_demo' else 'google_play' end as collect_source,
               case when substr(run_id, 5, 2) = '07' then 'other' else 'google_play' end as prep_source,
               'google_play' as pp_source,
               case when substr(run_id, 5, 2) = '08' then 'demo data' else null end as warning,
               case when substr(run_id, 5, 2) = '09' then '' else 'app' end as app_id,
               n_orders + case when substr(run_id, 5, 2) = '10' then 1 else 0 end as n_reviews
        from {v_runs}""",
    "v_bundle_files": """
        select run_id as bundle_id, 'reviews_raw.csv' as name from {v_runs} where substr(run_id, 5, 2) <> '01'
        union all select run_id as bundle_id, 'reviews_clean.csv' as name from {v_runs} where substr(run_id, 5, 2) <> '02'
        union all select run_id as bundle_id, 'painpoints.csv' as name from {v_runs} where substr(run_id, 5, 2) <> '03'
        union all select run_id as bundle_id, 'strengths.csv' as name from {v_runs} where substr(run_id, 5, 2) <> '04'
        union all select run_id as bundle_id, 'metadata.json' as name from {v_runs} where substr(run_id, 5, 2) <> '05'
        union all select run_id as bundle_id, 'preprocess_meta.json' as name from {v_runs} where substr(run_id, 5, 2) <> '06'
        union all select run_id as bundle_id, 'painpoints_meta.json' as name from {v_runs} where substr(run_id, 5, 2) <> '07'""",
    "v_bundle_raw": """
        select cast(year(o_orderdate) * 100 + month(o_orderdate) as string) as bundle_id,
               o_orderkey as seq, o_orderpriority as review,
               case when month(o_orderdate) = 1 then concat(o_orderpriority, '!')
                    else o_orderpriority end as review_now,
               case when o_orderkey % 997 = 0 then 'synthetic_demo' else 'google_play' end as source_type
        from {orders}""",
    "v_painpoint_cells": """
        select run_id as bundle_id, topic,
               cast(row_number() over (partition by run_id order by topic) as int) as row_no,
               case when freq % 41 = 0 then '1.5' when freq % 43 = 0 then 'abc'
                    else cast(freq as string) end as freq,
               case when freq % 37 = 0 then '5.5' when freq % 53 = 0 then 'nan'
                    else cast(avg_rating as string) end as avg_rating,
               case when freq % 29 = 0 then cast(mention_all_neg + 0.2 as string)
                    when freq % 47 = 0 then '-1' else cast(mention_all_neg as string) end as mention_all_pct,
               case when freq % 59 = 0 then '100.5' else cast(mention_assigned as string) end as mention_assigned_pct,
               case when freq % 31 = 0 then '  ' else topic end as rep_review
        from {v_mart_painpoints}""",
    "v_strength_cells": """
        select source_type as bundle_id, seq, review as rep_review,
               case when seq % 10 = 3 then 'x' else cast(rating as string) end as rating,
               case when seq % 14 = 5 then '-1' when seq % 16 = 7 then '2.5'
                    else cast(likes as string) end as likes,
               case when source_type in ('src1', 'src2') then 'deep_learning'
                    when source_type = 'src3' then 'guess' else 'rating_fallback' end as sentiment_method
        from {v_reviews} where rating >= 2""",
    "v_segment_manifests": """
        select cast(c_nationkey as string) as bundle_id, count(*) as n_respondents,
               case when c_nationkey % 5 = 0 then 'synthetic_demo' when c_nationkey % 7 = 3 then 'web'
                    else 'survey' end as source_type,
               case when c_nationkey % 4 = 1 then null else concat('h', cast(c_nationkey as string)) end as survey_hash,
               case when c_nationkey % 6 = 2 then 'other' else concat('h', cast(c_nationkey as string)) end as actual_survey_hash,
               concat('p', cast(c_nationkey as string)) as profile_hash,
               case when c_nationkey % 9 = 4 then 'x' else concat('p', cast(c_nationkey as string)) end as actual_profile_hash
        from {customer} group by c_nationkey""",
    # predicted answers per trial (order year) and the answers seen, per segment (order status)
    "v_predicted": """
        select cast(year(o_orderdate) as int) as trial, o_orderstatus as segment, o_orderpriority as category,
               cast(count(*) as double) as weight
        from {orders} group by year(o_orderdate), o_orderstatus, o_orderpriority""",
    "v_observed": """
        select o_orderstatus as segment,
               case when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then '6-OTHER'
                    else o_orderpriority end as category,
               count(*) as n
        from {orders} group by 1, 2""",
    # homes are customers; their devices are the parts they ordered
    "v_devices": """
        select distinct o.o_custkey as home_id, l.l_partkey as pos,
               concat('p', cast(l.l_partkey as string)) as device_ref,
               case when l.l_partkey % 50 = 0 then p.p_type else lower(p.p_type) end as device_type,
               replace(lower(p.p_brand), '#', '_') as cap1,
               concat('size_', cast(p.p_size % 2 as string)) as cap2
        from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey
        join {part} p on p.p_partkey = l.l_partkey""",
    "v_settings": """
        select d.home_id, d.device_ref, d.cap1 as setting_key, cast(d.pos % 40 as string) as value
        from {v_devices} d
        union all
        select d.home_id, d.device_ref,
               case when d.pos % 4 = 0 then 'odd_key' else d.cap2 end as setting_key,
               case when d.pos % 70 = 0 then repeat('v', 70)
                    else concat('v', cast(d.pos % 9 as string)) end as value
        from {v_devices} d""",
    "v_actions": """
        select o.o_custkey as home_id, l.l_orderkey as routine_id,
               l.l_linenumber as line_no, l.l_partkey as part_no, l.l_suppkey as supp_no,
               concat(case when l.l_tax > 0.075 then 'ghost' else 'p' end,
                      cast(l.l_partkey as string)) as device_ref,
               case when l.l_discount > 0.095 then 'odd_key'
                    else concat('size_', cast(p.p_size % 2 as string)) end as setting_key,
               cast(cast(l.l_quantity as int) as string) as value
        from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey
        join {part} p on p.p_partkey = l.l_partkey""",
    # one command per order, one item per line
    "v_command_items": """
        select l_orderkey as command_id, l_linenumber as line_no, l_partkey as part_no, l_suppkey as supp_no,
               case l_linenumber when 1 then 'power' when 2 then 'target_temp' when 3 then 'fan_speed'
                    when 4 then 'mode' when 5 then 'timer_min' when 6 then 'humidity'
                    else 'warp' end as capability,
               case l_linenumber when 1 then 'boolean' when 3 then 'string' when 4 then 'string'
                    else 'integer' end as value_type,
               case l_linenumber when 1 then case when l_returnflag = 'A' then 'true' else 'false' end
                    when 3 then case when l_returnflag = 'A' then 'low' when l_returnflag = 'N' then 'mid'
                                     else 'turbo' end
                    when 4 then 'cool'
                    else cast(cast(l_quantity as int) as string) end as value
        from {lineitem}""",
    "v_commands": """
        select event_id as seq, ts, user_id as device, event_type as capability,
               cast(floor(value / 50) as int) as value
        from {events}""",
    # challenges and the attempts that answer them
    "v_challenges": """
        select event_id as seq, ts, user_id as device,
               case when event_type = 'signup' then 'issue' else 'attempt' end as kind,
               case when event_type = 'click' and event_id % 11 = 0 then null
                    else cast(event_id % 3 as string) end as nonce
        from {events} where event_type in ('signup', 'click')""",
    "v_frames": """
        select conv_id as msg_id, cast(turn as int) as seq_no,
               cast(count(*) over (partition by conv_id)
                    + case when conv_id % 10 = 0 then 1 else 0 end as int) as total,
               text as payload
        from {conversations}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def _expand_rounding(sql: str, spelled: str) -> str:
    """Replace round_half(x, d) by the engine's spelling of half-even rounding."""
    start = sql.rfind("round_half(")
    while start >= 0:
        depth, at, comma = 1, start + len("round_half("), -1
        begin = at
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            if sql[at] == "," and depth == 1:
                comma = at
            at += 1
        scale = 10 ** int(sql[comma + 1 : at - 1])
        sql = sql[:start] + spelled.format(x=sql[begin:comma], scale=scale) + sql[at:]
        start = sql.rfind("round_half(")
    return sql


def _spark_text(sql: str) -> str:
    return _expand_rounding(sql, "(rint(({x}) * {scale}) / {scale})")


def _duck_text(sql: str) -> str:
    return _expand_rounding(sql, "(round_even(({x}) * {scale}, 0) / {scale})")


def spark_view(inputs, name: str) -> DataFrame:
    """The view as a DataFrame over the parquet folder behind `inputs`."""
    sql = _spark_text(VIEWS[name])
    parts = {dep: getattr(inputs, dep) for dep in set(_NAME.findall(sql))}
    return inputs.spark.sql(sql, **parts)


def with_views(sql: str) -> str:
    """Prepend the views a DuckDB text mentions, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    body = _duck_text(sql).strip()
    if not ordered:
        return body
    ctes = [
        f"{name} as ({_NAME.sub(lambda m: m.group(1), _duck_text(VIEWS[name])).strip()})"
        for name in ordered
    ]
    joined = ",\n".join(ctes)
    if re.match(r"with\s", body, re.IGNORECASE):
        return f"with {joined},\n{body[4:].strip()}"
    return f"with {joined}\n{body}"
