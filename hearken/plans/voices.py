"""Queries on app comparison and on search hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearken.functions import text
from hearken.operators import cleaning, compare, search
from hearken.plans import reviews
from hearken.plans.registry import Inputs, query
from hearken.session import scratch_dir
from hearken.sources import snapshots

# Patterns for the driver's Latin text; the Korean ones are the defaults of the operators.
SIGNALS = {"en": "tion|ing", "fr": "eau", "de": "ung", "es": "os"}
APP = "[Oo]n"
OFF = "http|www"
EXP = "the|le |und"
GUIDE = "STEP|[0-9]{3}"
SPON = "spam|[Ff]ree"
NOISE = "404|captcha"
RESET = "re[a-z]{0,10}(ing|tion)|[0-9]{2}.{0,12}(en|er)"

HIT_SQL = " ".join(
    f"when axis = '{a}' then regexp_matches(review, '{p}')" for a, p in SIGNALS.items()
)
FLAGGED = f"""flagged as (select *, case {HIT_SQL} else false end as axis_hit,
    regexp_matches(review, '{APP}') as app_mention, regexp_matches(review, '{OFF}') as off_topic,
    regexp_matches(review, '{SPON}') as sponsored,
    regexp_matches(review, '{EXP}') as experience, regexp_matches(review, '{GUIDE}') as guide_tone
    from v_reviews),
valid as (select * from flagged where axis_hit and app_mention and not off_topic)"""


def flagged(t: Inputs):
    return search.with_flags(t.v_reviews, SIGNALS, APP, OFF)


def valid(t: Inputs):
    kept = flagged(t).filter("valid")
    return search.with_tone(
        kept.withColumn("sponsored", text.matches(F.col("review"), SPON)), EXP, GUIDE
    )


# --- comparison ------------------------------------------------------------------------------

PERIOD = """lo as (select max(lo) as lo from (select min(review_date) as lo from v_reviews group by app)),
period as (select * from v_reviews, lo where review_date >= lo.lo)"""


@query(
    "union_apps",
    """select seq, rating, review_date, 'own' as app from v_reviews where app = 'own' union all
       select seq, rating, review_date, 'rival' from v_reviews where app = 'rival'""",
)
def _(t: Inputs):
    r = t.v_reviews.select("seq", "rating", "review_date", "app")
    parts = [(a, r.filter(F.col("app") == a).drop("app")) for a in ("own", "rival")]
    return compare.one_table(*parts)


@query("filter_common_period", f"with {PERIOD} select seq, app, review_date from period")
def _(t: Inputs):
    return compare.common_period(t.v_reviews, "review_date").select("seq", "app", "review_date")


@query("flag_reset_signal", f"select seq, regexp_matches(review, '{RESET}') as signal from v_reviews")
def _(t: Inputs):
    return t.v_reviews.select("seq", text.matches(F.col("review"), RESET).alias("signal"))


@query(
    "agg_monthly_trend",
    f"""with {PERIOD} select cast(date_trunc('month', review_date) as date) as month, app,
        count(*) as n_reviews,
        round_half(cast(count(*) filter (where rating = 1) as double) / count(*) * 100, 4) as one_star_pct,
        round_half(avg(rating), 4) as avg_rating
        from period group by 1, 2""",
)
def _(t: Inputs):
    return compare.monthly_trend(compare.common_period(t.v_reviews, "review_date"), "review_date")


@query(
    "agg_app_summary",
    f"""with {PERIOD} select app, count(*) as n_reviews,
        round_half(cast(count(*) filter (where rating = 1) as double) / count(*) * 100, 1) as one_star_pct,
        round_half(avg(rating), 2) as avg_rating,
        count(*) filter (where regexp_matches(review, '{RESET}')) as signal_n,
        round_half(cast(count(*) filter (where regexp_matches(review, '{RESET}')) as double) / count(*) * 100, 2) as signal_pct
        from period group by app""",
)
def _(t: Inputs):
    return compare.app_summary(compare.common_period(t.v_reviews, "review_date"), RESET)


@query("agg_rating_hist", "select rating, count(*) as n from v_ratings group by rating")
def _(t: Inputs):
    return compare.rating_histogram(t.v_ratings)


_HASH, _ROW = reviews.sql_lanes(
    "length(seq::varchar) || '=' || seq, coalesce(length(review) || '=' || review, '~'), "
    "coalesce(length(rating::varchar) || '=' || rating, '~')"
)


@query(
    "manifest_crawl",
    f"""with g as (select app, rating, count(*) as n, min(review_date) as lo, max(review_date) as hi
                  from v_reviews group by 1, 2),
       h as (select app, {_HASH} as content_hash from (select app, {_ROW} as h from v_reviews) group by app)
       select app, cast(sum(n) as bigint) as n_reviews, min(lo) as first_date, max(hi) as last_date,
              array_to_string(list_sort(list(coalesce(cast(rating as varchar), 'none') || ':' || n)), ',')
                as rating_dist, any_value(content_hash) as content_hash
       from g join h using (app) group by app""",
)
def _(t: Inputs):
    """Every crawl is published on its own; its manifest is observed in the pass that writes it."""
    path = scratch_dir(t.spark, "crawls")
    told = []
    for app in ("own", "rival"):
        crawl = t.v_reviews.filter(F.col("app") == app).select("seq", "review", "rating", "review_date", "likes")
        told.append({"app": app, **snapshots.observed(crawl, f"{path}/{app}", app, compare.crawl_metrics("review_date"))})
    schema = "app string, n_reviews bigint, first_date date, last_date date, rating_dist string, content_hash string"
    return t.spark.createDataFrame([m for m in told if m["n_reviews"]], schema)


# --- search hits -----------------------------------------------------------------------------


@query("strip_tags", "select seq, regexp_replace(markup, '<[^>]+>', '', 'g') as review from v_hits")
def _(t: Inputs):
    return t.v_hits.select("seq", text.strip_tags(F.col("markup")).alias("review"))


HITS = "hits as (select *, regexp_replace(markup, '<[^>]+>', '', 'g') as review from v_hits)"


def hits(t: Inputs):
    return t.v_hits.withColumn("review", text.strip_tags(F.col("markup")))


@query("flag_sponsored", f"with {HITS} select seq, regexp_matches(review, '{SPON}') as sponsored from hits")
def _(t: Inputs):
    return hits(t).select("seq", text.matches(F.col("review"), SPON).alias("sponsored"))


@query("filter_device_noise", f"with {HITS} select seq, link from hits where not regexp_matches(review, '{NOISE}')")
def _(t: Inputs):
    return search.without_device_noise(hits(t), NOISE).select("seq", "link")


@query(
    "cap_per_query",
    """select seq, query, origin from v_hits
       qualify row_number() over (partition by query, origin order by seq) <= 5""",
)
def _(t: Inputs):
    return cleaning.top_per_key(t.v_hits, ["query", "origin"], ["seq"], 5).select("seq", "query", "origin")


@query(
    "dedup_link",
    """select seq, link from v_hits
       qualify row_number() over (partition by link order by seq) = 1""",
)
def _(t: Inputs):
    return cleaning.first_per_key(t.v_hits, ["link"], ["seq"]).select("seq", "link")


@query(
    "manifest_search",
    f"""with {HITS},
    uniq as (select * from hits qualify row_number() over (partition by link order by seq) = 1)
    select origin, count(*) as n_rows, count(*) filter (where regexp_matches(review, '{SPON}')) as sponsored_rows
    from uniq where not regexp_matches(review, '{NOISE}') group by origin""",
)
def _(t: Inputs):
    return search.manifest(search.collect_hits(hits(t), None, SPON, NOISE))


_SHASH, _SROW = reviews.sql_lanes(
    "length(seq::varchar) || '=' || seq, coalesce(length(review) || '=' || review, '~'), coalesce(length(axis) || '=' || axis, '~')"
)


@query(
    "manifest_search_run",
    f"""with {FLAGGED}, y as (select axis, count(*) as n, count(*) filter (where axis_hit and app_mention and not off_topic) as v
          from flagged where axis in ({', '.join(f"'{a}'" for a in SIGNALS)}) group by axis),
        h as (select {_SHASH} as content_hash from (select {_SROW} as h from flagged))
        select (select count(*) from flagged) as n_rows, (select count(*) from flagged where sponsored) as sponsored_rows,
          (select string_agg(axis || ':' || n || ':' || v, ',' order by list_position([{', '.join(f"'{a}'" for a in SIGNALS)}], axis)) from y) as axis_yield,
          coalesce((select string_agg(axis, ',' order by list_position([{', '.join(f"'{a}'" for a in SIGNALS)}], axis)) from y
            where cast(v as double) / n * 100 >= 18.8), '') as adopted, content_hash from h""",
)
def _(t: Inputs):
    marked = flagged(t).withColumn("sponsored", text.matches(F.col("review"), SPON))
    rows = marked.select("seq", "review", "axis", "axis_hit", "app_mention", "off_topic", "valid", "sponsored")
    told = snapshots.observed(rows, scratch_dir(t.spark, "search-run"), "search", search.search_metrics(list(SIGNALS)))
    schema = "n_rows bigint, sponsored_rows bigint, axis_yield string, adopted string, content_hash string"
    return t.spark.createDataFrame([told], schema)


@query("join_axis_pattern", f"with {FLAGGED} select seq, axis, axis_hit from flagged")
def _(t: Inputs):
    return flagged(t).select("seq", "axis", "axis_hit")


@query("filter_valid_hits", f"with {FLAGGED} select seq, axis from valid")
def _(t: Inputs):
    return flagged(t).filter("valid").select("seq", "axis")


@query(
    "agg_axis_yield",
    f"""with {FLAGGED}, g as (select axis, count(*) as collected,
        count(*) filter (where axis_hit) as signal_n, count(*) filter (where app_mention) as app_n,
        count(*) filter (where off_topic) as off_topic_n,
        count(*) filter (where axis_hit and app_mention and not off_topic) as valid_n
        from flagged group by axis)
    select *, round_half(cast(valid_n as double) / collected * 100, 1) as valid_pct,
        case when cast(valid_n as double) / collected * 100 >= 18.8 then 'adopt' else 'redesign' end as verdict
    from g""",
)
def _(t: Inputs):
    return search.axis_yield(flagged(t), list(SIGNALS))


@query("agg_axis_counts", f"with {FLAGGED} select axis, count(*) as n from valid group by axis")
def _(t: Inputs):
    return flagged(t).filter("valid").groupBy("axis").agg(F.count(F.lit(1)).alias("n"))


@query("flag_experience", f"with {FLAGGED} select seq, experience from valid")
def _(t: Inputs):
    return valid(t).select("seq", "experience")


@query("flag_guide_tone", f"with {FLAGGED} select seq, guide_tone from valid")
def _(t: Inputs):
    return valid(t).select("seq", "guide_tone")


@query(
    "testimony_rank",
    f"""with {FLAGGED} select seq, axis, experience, guide_tone, sponsored from valid
        order by experience desc, guide_tone, sponsored, seq""",
)
def _(t: Inputs):
    return search.testimonies(
        valid(t).select("seq", "axis", "experience", "guide_tone", "sponsored")
    )
