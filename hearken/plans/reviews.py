"""Queries on reviews: cleaning, sentiment, pain points, strengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearken.functions import hashing, text
from hearken.functions.fixed_values import CLEAN_KEEP, LABEL_MAP, STOPWORDS, WORD_CHART_STOPWORDS
from hearken.operators import cleaning, painpoints, sentiment
from hearken.plans.registry import Inputs, query

# The driver's text is Latin script; a few of its frequent words stand in for domain stopwords.
LATIN_STOP = ("the", "of", "la", "le", "und", "der", "que")
STOP = (*STOPWORDS, *LATIN_STOP)


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


CLEAN = f"trim(regexp_replace(review, '[^{CLEAN_KEEP}]+', ' ', 'g'))"

# CTEs shared by the twins
CLEAN_CTES = f"""
cleaned as (select * exclude (review), {CLEAN} as review from v_reviews),
uniq as (select * from cleaned where length(review) >= 5
         qualify row_number() over (partition by review order by seq) = 1),
toks as (select *, list_filter(string_split(review, ' '), lambda x: x not in ({quoted(STOP)}, ''))
              as tokens from uniq),
clean as (select * from toks where len(tokens) > 0)"""

NEG_CTES = """
neg as (select * from v_reviews where rating <= 3),
counts as (select topic, count(*) as freq, round_half(avg(rating), 2) as avg_rating
           from neg group by topic),
tot as (select sum(freq) as n_all, sum(case when topic <> -1 then freq end) as n_assigned from counts),
pp as (select topic, freq, avg_rating,
              round_half(cast(freq as double) / cast(n_all as double) * 100, 1) as mention_all_pct,
              round_half(cast(freq as double) / cast(n_assigned as double) * 100, 1) as mention_assigned_pct
       from counts, tot where topic <> -1),
rep as (select topic, seq, review from neg where topic <> -1
        qualify row_number() over (partition by topic order by topic_prob desc, seq) = 1)"""

PRIORITY_CTES = (
    NEG_CTES
    + """,
sev as (select *, round_half(5 - avg_rating, 2) as severity from pp),
med as (select median(mention_all_pct) as m, median(severity) as s, max(freq) as f from sev)"""
)


def clean(t: Inputs):
    return cleaning.clean_reviews(t.v_reviews, STOP)


def negatives(t: Inputs):
    labelled = sentiment.label_by_rating(t.v_reviews)
    return labelled.filter(F.col("sentiment") == "neg")


def ranked_pain_points(t: Inputs):
    """Flagship: clean, deduplicate, label, aggregate, quote, score and rank."""
    labelled = sentiment.label_by_rating(clean(t))
    points = painpoints.pain_points(labelled.filter(F.col("sentiment") == "neg"))
    return painpoints.with_priority(points).orderBy(F.desc("priority_score"), "topic")


query(
    "pain_point_ranking",
    f"""with {CLEAN_CTES},
neg as (select * from clean where rating <= 3),
counts as (select topic, count(*) as freq, round_half(avg(rating), 2) as avg_rating
           from neg group by topic),
tot as (select sum(freq) as n_all, sum(case when topic <> -1 then freq end) as n_assigned from counts),
pp as (select topic, freq, avg_rating,
              round_half(cast(freq as double) / cast(n_all as double) * 100, 1) as mention_all_pct,
              round_half(cast(freq as double) / cast(n_assigned as double) * 100, 1) as mention_assigned_pct
       from counts, tot where topic <> -1),
rep as (select topic, seq, review from neg where topic <> -1
        qualify row_number() over (partition by topic order by topic_prob desc, seq) = 1),
sev as (select *, round_half(5 - avg_rating, 2) as severity from pp),
med as (select median(mention_all_pct) as m, median(severity) as s, max(freq) as f from sev)
select sev.*, substr(coalesce(rep.review, ''), 1, 100) as rep_review,
       round_half(mention_all_pct * severity, 1) as priority_score,
       cast(100 as double) + cast(500 as double) * (cast(freq as double) / f) as bubble_size,
       case when mention_all_pct >= m and severity >= s then 'first'
            when severity >= s then 'severe_rare' when mention_all_pct >= m then 'mild_frequent'
            else 'low' end as quadrant
from sev left join rep using (topic), med""".replace("sev.*", "sev.topic, sev.freq, sev.avg_rating, sev.mention_all_pct, sev.mention_assigned_pct, sev.severity"),
)(ranked_pain_points)


# --- text cleaning ---------------------------------------------------------------------------


@query("clean_text", f"select seq, {CLEAN} as review from v_reviews")
def _(t: Inputs):
    return t.v_reviews.select("seq", text.clean_text(F.col("review")).alias("review"))


@query("filter_minlen", f"select seq from (select seq, {CLEAN} as r from v_reviews) where length(r) >= 5")
def _(t: Inputs):
    return t.v_reviews.filter(F.length(text.clean_text(F.col("review"))) >= 5).select("seq")


@query("dedup_first", f"with {CLEAN_CTES} select seq, review, rating from uniq")
def _(t: Inputs):
    kept = cleaning.long_enough(t.v_reviews)
    return cleaning.first_per_key(kept, ["review"], ["seq"]).select("seq", "review", "rating")


@query(
    "dedup_review_date",
    """select seq, source_type from v_reviews
       qualify row_number() over (partition by review, review_date order by seq) = 1""",
)
def _(t: Inputs):
    kept = cleaning.first_per_key(t.v_reviews, ["review", "review_date"], ["seq"])
    return kept.select("seq", "source_type")


@query(
    "tokenize_ws",
    f"with {CLEAN_CTES} select seq, array_to_string(tokens, ' ') as tokens from toks",
)
def _(t: Inputs):
    unique = cleaning.first_per_key(cleaning.long_enough(t.v_reviews), ["review"], ["seq"])
    return unique.select("seq", F.array_join(text.tokens(F.col("review"), STOP), " ").alias("tokens"))


@query(
    "filter_nonempty_tokens",
    f"""with {CLEAN_CTES} select seq, review, rating, review_date, likes, source_type,
        array_to_string(tokens, ' ') as tokens from clean""",
)
def _(t: Inputs):
    return clean(t).select(
        "seq", "review", "rating", "review_date", "likes", "source_type",
        F.array_join("tokens", " ").alias("tokens"),
    )


@query(
    "stopword_sets",
    f"""select word, count(*) as freq from
        (select unnest(string_split({CLEAN}, ' ')) as word from v_reviews)
        where lower(word) in ({quoted((*WORD_CHART_STOPWORDS, *LATIN_STOP))}) group by word""",
)
def _(t: Inputs):
    stop = [*WORD_CHART_STOPWORDS, *LATIN_STOP]
    words = t.v_reviews.select(F.explode(F.split(text.clean_text(F.col("review")), " ")).alias("word"))
    hits = words.filter(F.lower("word").isin(stop))
    return hits.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


WORD_FREQ = f"""select word, count(*) as freq from
        (select unnest(string_split({CLEAN}, ' ')) as word from v_reviews)
        where lower(word) not in ({quoted((*WORD_CHART_STOPWORDS, *LATIN_STOP))})
          and length(word) >= 2 group by word"""


def word_freq(t: Inputs):
    cleaned = t.v_reviews.select(text.clean_text(F.col("review")).alias("review"))
    return cleaning.token_counts(cleaned, (*WORD_CHART_STOPWORDS, *LATIN_STOP))


query("agg_word_freq", WORD_FREQ)(word_freq)


@query("topk_words", f"{WORD_FREQ} order by freq desc, word limit 100")
def _(t: Inputs):
    return word_freq(t).orderBy(F.desc("freq"), "word").limit(100)


@query(
    "truncate",
    """select seq, substr(review, 1, 512) as model_text, substr(review, 1, 100) as quote,
       substr(source_type, 1, 14) as chart_label from v_reviews""",
)
def _(t: Inputs):
    r = F.col("review")
    return t.v_reviews.select(
        "seq",
        text.head(r, 512).alias("model_text"),
        text.head(r, 100).alias("quote"),
        text.head(F.col("source_type"), 14).alias("chart_label"),
    )


@query("stamp_origin", "select seq, 'playstore_review' as origin from v_reviews where rating <= 3")
def _(t: Inputs):
    low = t.v_reviews.filter(F.col("rating") <= 3)
    return low.select("seq", F.lit("playstore_review").alias("origin"))


@query("filter_low_rating", "select seq, rating, likes from v_reviews where rating <= 3")
def _(t: Inputs):
    return t.v_reviews.filter(F.col("rating") <= 3).select("seq", "rating", "likes")


def sql_lanes(cells: str) -> str:
    """The DuckDB spelling of the four-lane fingerprint."""
    lanes = ", ".join(
        f"coalesce(sum(cast(('0x' || substr(h, {1 + 15 * i}, 15))::bigint as decimal(38,0))), 0)::varchar"
        for i in range(4)
    )
    return f"sha256(concat_ws(',', count(*)::varchar, {lanes}))", f"sha256(concat_ws(chr(31), {cells}))"


_HASH, _ROW = sql_lanes(
    "length(seq::varchar) || '=' || seq, coalesce(length(review) || '=' || review, '~'), "
    "coalesce(length(rating::varchar) || '=' || rating, '~')"
)


@query(
    "content_hash",
    f"""select source_type, count(*) as row_count, {_HASH} as content_hash
        from (select source_type, {_ROW} as h from v_reviews) group by source_type""",
)
def _(t: Inputs):
    return hashing.fingerprint(t.v_reviews, ["seq", "review", "rating"], ["source_type"])


# --- sentiment -------------------------------------------------------------------------------


@query(
    "sentiment_rating",
    """select seq, case when rating <= 3 then 'neg' else 'pos' end as sentiment,
       'rating_fallback' as sentiment_method from v_reviews""",
)
def _(t: Inputs):
    return sentiment.label_by_rating(t.v_reviews).select("seq", "sentiment", "sentiment_method")


MODEL_SENTIMENT = """case model_label when 'LABEL_0' then 'neg' when 'LABEL_1' then 'pos' end"""


@query(
    "sentiment_from_labels",
    f"""select seq, {MODEL_SENTIMENT} as sentiment, 'deep_learning' as sentiment_method
        from v_labelled""",
)
def _(t: Inputs):
    labelled = sentiment.label_by_model(t.v_labelled, "model_label", LABEL_MAP)
    return labelled.select("seq", "sentiment", "sentiment_method")


@query(
    "label_whitelist",
    """with ok as (select bool_and(coalesce(loose_label in ('LABEL_0', 'LABEL_1'), false)) as b
                   from v_labelled)
       select seq, case when b then case loose_label when 'LABEL_0' then 'neg' else 'pos' end
                        when rating <= 3 then 'neg' else 'pos' end as sentiment,
              case when b then 'deep_learning' else 'rating_fallback' end as sentiment_method
       from v_labelled, ok""",
)
def _(t: Inputs):
    labelled = sentiment.label_by_model(t.v_labelled, "loose_label", LABEL_MAP)
    return labelled.select("seq", "sentiment", "sentiment_method")


@query(
    "agg_negative_share",
    """select count(*) as n_reviews, count(*) filter (where rating <= 3) as n_negative,
       round_half(cast(count(*) filter (where rating <= 3) as double) / count(*) * 100, 1) as negative_pct
       from v_reviews""",
)
def _(t: Inputs):
    return sentiment.negative_share(sentiment.label_by_rating(t.v_reviews))


@query(
    "agg_sentiment_by_origin",
    f"""select source_type as origin, {MODEL_SENTIMENT} as sentiment, count(*) as n
        from v_labelled group by 1, 2""",
)
def _(t: Inputs):
    labelled = sentiment.label_by_model(t.v_labelled, "model_label", LABEL_MAP)
    return sentiment.by_origin(labelled.withColumnRenamed("source_type", "origin"))


@query(
    "pivot_rating_sentiment",
    f"""select rating, count(*) filter (where s = 'neg') as neg, count(*) filter (where s = 'pos') as pos
        from (select rating, {MODEL_SENTIMENT} as s from v_labelled) where rating is not null
        group by rating""",
)
def _(t: Inputs):
    return sentiment.rating_crosstab(sentiment.label_by_model(t.v_labelled, "model_label", LABEL_MAP))


@query(
    "union_corpus",
    r"""select seq, review, rating, 'playstore_review' as origin, cast(null as varchar) as link
        from v_reviews where rating <= 3
        union all
        select seq, regexp_replace(markup, '<[^>]+>', '', 'g'), null, origin, link from v_hits""",
)
def _(t: Inputs):
    low = t.v_reviews.filter(F.col("rating") <= 3)
    reviews = low.select("seq", "review", "rating", F.lit("playstore_review").alias("origin"))
    hits = t.v_hits.select("seq", text.strip_tags(F.col("markup")).alias("review"), "origin", "link")
    return reviews.unionByName(hits, allowMissingColumns=True)


# --- pain points -----------------------------------------------------------------------------


@query("filter_noise_topic", "select seq, topic from v_reviews where rating <= 3 and topic <> -1")
def _(t: Inputs):
    return painpoints.assigned_only(negatives(t)).select("seq", "topic")


@query("agg_painpoints", f"with {NEG_CTES} select topic, freq, avg_rating from counts where topic <> -1")
def _(t: Inputs):
    return painpoints.assigned_only(painpoints.topic_counts(negatives(t)))


@query("agg_mention_dual", f"with {NEG_CTES} select * from pp")
def _(t: Inputs):
    return painpoints.with_mentions(painpoints.topic_counts(negatives(t)))


@query("mention_single", f"with {NEG_CTES} select topic, freq, mention_assigned_pct as mention_pct from pp")
def _(t: Inputs):
    points = painpoints.with_mentions(painpoints.topic_counts(negatives(t)))
    return points.select("topic", "freq", F.col("mention_assigned_pct").alias("mention_pct"))


@query(
    "agg_noise_rate",
    f"""with {NEG_CTES},
    noise as (select coalesce(sum(freq) filter (where topic = -1), 0) as n from counts)
    select cast(n_all as bigint) as negative_count, cast(n as bigint) as noise_count,
           round_half(cast(n as double) / cast(n_all as double) * 100, 1) as noise_pct from tot, noise""",
)
def _(t: Inputs):
    return painpoints.noise_rate(painpoints.topic_counts(negatives(t)))


@query("sort_freq", f"with {NEG_CTES} select topic, freq from pp order by freq desc, topic limit 8")
def _(t: Inputs):
    points = painpoints.assigned_only(painpoints.topic_counts(negatives(t)))
    return points.select("topic", "freq").orderBy(F.desc("freq"), "topic").limit(8)


@query("rep_argmax", f"with {NEG_CTES} select topic, seq, review as rep_review from rep")
def _(t: Inputs):
    return painpoints.representative(painpoints.assigned_only(negatives(t)))


@query(
    "join_rep_quote",
    f"""with {NEG_CTES} select pp.*, substr(coalesce(rep.review, ''), 1, 100) as rep_review
        from pp left join rep using (topic)""",
)
def _(t: Inputs):
    found = negatives(t)
    points = painpoints.with_mentions(painpoints.topic_counts(found))
    return painpoints.with_quotes(
        points, painpoints.representative(painpoints.assigned_only(found))
    )


@query(
    "join_labels",
    """select seq, topic, case when topic = 0 then 'T0_login' when topic = 1 then 'T1_network'
       when topic = 2 then 'T2_update' end as topic_label from v_reviews where rating <= 3""",
)
def _(t: Inputs):
    names = {0: "T0_login", 1: "T1_network", 2: "T2_update"}
    lookup = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    label = F.try_element_at(lookup, F.col("topic"))
    return negatives(t).select("seq", "topic", label.alias("topic_label"))


@query(
    "topk_strengths",
    """select seq, review, rating, likes from v_reviews where rating > 3 or rating is null
       order by rating desc nulls last, likes desc nulls last, seq limit 10""",
)
def _(t: Inputs):
    return painpoints.strengths(sentiment.label_by_rating(t.v_reviews))


def priority(t: Inputs):
    return painpoints.with_priority(painpoints.with_mentions(painpoints.topic_counts(negatives(t))))


@query(
    "painpoint_table",
    f"""with {NEG_CTES} select pp.*, substr(coalesce(rep.review, ''), 1, 100) as rep_review
        from pp left join rep using (topic)""",
)
def _(t: Inputs):
    return painpoints.pain_points(negatives(t))


@query("severity", f"with {PRIORITY_CTES} select topic, severity from sev")
def _(t: Inputs):
    return priority(t).select("topic", "severity")


@query(
    "priority_score",
    f"""with {PRIORITY_CTES} select topic, mention_all_pct, severity,
        round_half(mention_all_pct * severity, 1) as priority_score from sev""",
)
def _(t: Inputs):
    scored = priority(t).select("topic", "mention_all_pct", "severity", "priority_score")
    return scored.orderBy(F.desc("priority_score"), "topic")


@query(
    "bubble_size",
    f"""with {PRIORITY_CTES} select topic,
        cast(100 as double) + cast(500 as double) * (cast(freq as double) / f) as bubble_size
        from sev, med""",
)
def _(t: Inputs):
    return priority(t).select("topic", "bubble_size")


@query(
    "quadrant",
    f"""with {PRIORITY_CTES} select topic,
        case when mention_all_pct >= m and severity >= s then 'first'
             when severity >= s then 'severe_rare' when mention_all_pct >= m then 'mild_frequent'
             else 'low' end as quadrant
        from sev, med""",
)
def _(t: Inputs):
    return priority(t).select("topic", "quadrant")
