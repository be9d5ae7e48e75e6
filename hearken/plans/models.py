"""Queries on vectors, topics and segment models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.functions.fixed_values import COUNT_TERMS, FEATURE_HEADERS, LDA_TOPICS, TFIDF_TERMS, TOPICS_ON_VECTORS
from hearken.functions.numeric import round_even
from hearken.operators import kmeans, segments, survey, topics, vectors
from hearken.plans import reviews
from hearken.plans.registry import Inputs, query
from hearken.plans.surveys import ENCODED, answers
from hearken.session import materialize, scratch_dir
from hearken.sources import readers

WORDS = r"regexp_extract_all(lower(array_to_string(tokens, ' ')), '[\p{L}\p{N}_]{2,}')"
TERM_CTES = f"""{reviews.CLEAN_CTES},
ws as (select seq, topic, {WORDS} as ws from clean),
n as (select cast(count(*) as double) as n from clean),
tf as (select seq, term, count(*) as tf from
        (select seq, unnest(list_concat(ws, list_transform(range(1, len(ws)),
                 lambda i: ws[i] || ' ' || ws[i + 1]))) as term from ws) group by 1, 2),
vocab as (select term, sum(tf) as ctf, count(*) as df from tf group by term
          having count(*) >= (select case when n < 20 then 1 else 2 end from n)
          order by ctf desc, term limit 2000),
w as (select tf.seq, tf.term, tf.tf, tf.tf * (ln((1 + n.n) / (1 + cast(v.df as double))) + 1) as w
      from tf join vocab v on v.term = tf.term, n),
norm as (select seq, sqrt(sum(w * w)) as len from w group by seq),
x as (select w.seq, w.term, w.tf, w.w / norm.len as tfidf from w join norm on norm.seq = w.seq)"""


def tokenised(t: Inputs):
    return reviews.clean(t).select(
        "seq", "review", "rating", "topic", F.array_join("tokens", " ").alias("tokens")
    )


def weights(t: Inputs):
    """TF-IDF with the published limits: 2,000 terms, and words that occur once only in small corpora."""
    docs = tokenised(t)
    return vectors.tfidf(docs, max_terms=TFIDF_TERMS, least_df=vectors.published_min_df(vectors.corpus_size(docs)))


@query("tfidf", f"with {TERM_CTES} select seq, term, tf, round_half(tfidf, 6) as tfidf from x")
def _(t: Inputs):
    return weights(t).withColumn("tfidf", round_even(F.col("tfidf"), 6))


@query(
    "agg_top_terms",
    f"""with {TERM_CTES}, s as (select term, round_half(sum(tfidf), 4) as score from x group by term)
        select term, score from s order by score desc, term limit 15""",
)
def _(t: Inputs):
    return vectors.top_terms(weights(t))


@query(
    "count_vectorize",
    f"""with {reviews.CLEAN_CTES}, ws as (select seq, unnest({WORDS}) as term from clean),
        tf as (select seq, term, count(*) as tf from ws group by 1, 2),
        vocab as (select term from tf group by term
                  having count(*) >= (select case when count(*) < 20 then 1 else 2 end from clean)
                  order by sum(tf) desc, term limit 1000)
        select seq, term, tf from tf where term in (select term from vocab)""",
)
def _(t: Inputs):
    docs = tokenised(t)
    return vectors.count_vectors(docs, COUNT_TERMS, vectors.published_min_df(vectors.corpus_size(docs)))


TOPIC_WORDS = f"""{reviews.CLEAN_CTES},
ws as (select topic, unnest({WORDS}) as word from clean where rating <= 3),
c as (select topic, word, count(*) as tf from ws group by 1, 2),
f as (select word, cast(sum(tf) as bigint) as everywhere from c group by word),
m as (select cast(sum(tf) as double) / count(distinct topic) as mean_words from c),
k as (select c.topic, c.word, c.tf, c.tf * ln(1 + m.mean_words / f.everywhere) as weight
      from c join f on f.word = c.word, m
      qualify row_number() over (partition by c.topic order by weight desc, c.word) <= 4)"""


def low_rated(t: Inputs):
    return tokenised(t).filter(F.col("rating") <= 3)


@query("topk_terms_per_topic", f"with {TOPIC_WORDS} select topic, word, tf, round_half(weight, 4) as weight from k")
def _(t: Inputs):
    words = topics.topic_words(low_rated(t))
    return words.withColumn("weight", round_even(F.col("weight"), 4))


@query(
    "topic_labels",
    f"""with {TOPIC_WORDS} select topic, topic || '_' ||
        array_to_string(list(word order by weight desc, word), '_') as topic_label from k group by topic""",
)
def _(t: Inputs):
    return topics.topic_labels(topics.topic_words(low_rated(t)))


@query("topics_lda")
def _(t: Inputs):
    docs = materialize(low_rated(t), "lda-docs")
    assigned, _table = topics.lda_topics(docs, k=LDA_TOPICS)
    return assigned.select("seq", "topic", "topic_label", F.round("topic_prob", 4).alias("topic_prob"))


@query("lda_topic_terms")
def _(t: Inputs):
    docs = materialize(low_rated(t), "lda-docs")
    return topics.lda_topics(docs, k=LDA_TOPICS)[1]


# --- embeddings ------------------------------------------------------------------------------


@query(
    "join_embeddings",
    """select r.seq, r.topic, cast(len(e.embedding) as int) as dims,
       round_half(cast(e.embedding[1] as double), 6) as first_value
       from v_reviews r join embeddings e on e.vec_id = r.seq where r.rating <= 3""",
)
def _(t: Inputs):
    joined = vectors.with_embeddings(t.v_reviews.filter(F.col("rating") <= 3), t.embeddings)
    first = round_even(F.col("embedding")[0], 6)
    return joined.select("seq", "topic", F.size("embedding").alias("dims"), first.alias("first_value"))


@query(
    "src_embeddings",
    """with j as (select r.seq, e.vec_id, e.embedding,
         len(e.embedding) > 0 and len(list_filter(e.embedding, lambda x: isnan(x) or isinf(x))) = 0 as good
         from v_reviews r full join embeddings e on e.vec_id = r.seq),
       g as (select count(seq) as n_docs, count(vec_id) as n_vectors,
         count(*) filter (where seq is not null and vec_id is not null) as n_matched,
         count(*) filter (where vec_id is not null and not good) as n_broken,
         cast(min(len(embedding)) as int) as min_dim, cast(max(len(embedding)) as int) as max_dim from j)
       select *, n_docs = n_matched and n_vectors = n_matched and n_broken = 0 and min_dim = max_dim as usable
       from g""",
)
def _(t: Inputs):
    return vectors.embedding_check(t.v_reviews, t.embeddings)


_HASH, _ROW = reviews.sql_lanes("length(seq::varchar) || '=' || seq, coalesce(length(review) || '=' || review, '~')")


@query(
    "manifest_embed",
    f"""select {_HASH} as document_hash, count(*) as row_count, 'jhgan/ko-sroberta-multitask' as model,
        (select count(*) > 0 from embeddings) as available
        from (select {_ROW} as h from v_reviews)""",
)
def _(t: Inputs):
    return vectors.embedding_manifest(t.v_reviews, t.embeddings)


# documents that have a vector; what the manifests say of them is landed as files, one of them true
CASES = {"good": "", "model": "sbert_model", "hash": "document_hash", "rows": "row_count", "absent": "sbert_available"}
EMBEDDED = """v_embedded as (select * from v_reviews where seq in (select vec_id from embeddings where embedding is not null)),
  v_vectors as (select * from embeddings where vec_id in (select seq from v_reviews))"""


def embedded(t: Inputs):
    docs = t.v_reviews.join(t.embeddings.filter("embedding is not null").select(F.col("vec_id").alias("seq")), "seq", "left_semi")
    return docs, t.embeddings.join(t.v_reviews.select(F.col("seq").alias("vec_id")), "vec_id", "left_semi")


def landed_manifests(t: Inputs, docs, cases=tuple(CASES)):
    """The manifest of `docs`, once as it is and once with each of its members changed."""
    path = scratch_dir(t.spark, "embedding-manifests")
    true = vectors.embedding_manifest(docs, t.embeddings).select(
        "document_hash", "row_count", F.col("model").alias("sbert_model"), F.col("available").alias("sbert_available")
    )
    wrong = {
        "document_hash": F.reverse("document_hash"), "row_count": F.col("row_count") + 1, "sbert_model": F.lit("other"),
        "sbert_available": F.lit(False),
    }
    told = [
        true.select(F.lit(case).alias("case"), *[(wrong[c] if c == CASES[case] else F.col(c)).alias(c) for c in true.columns]) for case in cases
    ]
    reduce(DataFrame.unionByName, told).write.partitionBy("case").json(path)
    return readers.embedding_manifests(t.spark, path)


@query(
    "src_embeddings_recorded",
    f"""with {EMBEDDED}, cases(name, refused) as (values ('good', cast(null as varchar)), ('model', 'model_differs'),
         ('hash', 'document_hash_differs'), ('rows', 'row_count_differs'), ('absent', 'not_available')),
       r as (select cast(count(*) as bigint) + (name = 'rows')::int as row_count, name, refused from v_embedded, cases group by name, refused),
       good as (select count(*) filter (where len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) > 0 or len(embedding) = 0) as n_broken,
         min(len(embedding)) = max(len(embedding)) as even from v_vectors)
       select name as "case", row_count,
         coalesce(refused, case when n_broken > 0 then 'broken_vectors' when not even then 'dimensions_differ' end) as refused,
         refused is null and n_broken = 0 and even as usable from r, good""",
)
def _(t: Inputs):
    docs, known = embedded(t)
    return vectors.judge_embeddings(docs, known, landed_manifests(t, docs)).select("case", "row_count", "refused", "usable")


@query(
    "embedding_features",
    f"""with {EMBEDDED} select seq, 'vectors' as engine, cast(len(embedding) as bigint) as n_features, round_half(s, 4) as total
        from (select vec_id as seq, embedding, list_sum(list_transform(embedding, lambda x: cast(x as double) * x)) as s from v_vectors)""",
)
def _(t: Inputs):
    docs, known = embedded(t)
    told = vectors.document_features(docs.withColumn("tokens", F.coalesce("review", F.lit(""))), known, landed_manifests(t, docs, ("good",)))
    sums = told.groupBy("seq", "engine").agg(F.count(F.lit(1)).alias("n_features"), F.sum(F.col("value") * F.col("value")).alias("s"))
    return sums.select("seq", "engine", "n_features", round_even(F.col("s"), 4).alias("total"))


@query(
    "embedding_fallback",
    f"""with {EMBEDDED}, w as (select seq, regexp_extract_all(lower(coalesce(review, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') as ws from v_embedded),
       x as (select seq, unnest(ws) as term from w union all
             select seq, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) from w)
       select seq, 'words' as engine, count(distinct term) as n_features, 1.0::double as total from x group by seq""",
)
def _(t: Inputs):
    docs, known = embedded(t)
    told = vectors.document_features(docs.withColumn("tokens", F.coalesce("review", F.lit(""))), known, landed_manifests(t, docs, ("hash",)))
    sums = told.groupBy("seq", "engine").agg(F.count(F.lit(1)).alias("n_features"), F.sum(F.col("value") * F.col("value")).alias("s"))
    return sums.select("seq", "engine", "n_features", round_even(F.col("s"), 4).alias("total"))


@query("topics_embedding")
def _(t: Inputs):
    low = t.v_reviews.filter(F.col("rating") <= 3).drop("topic", "topic_prob")
    docs = materialize(vectors.with_embeddings(low, t.embeddings), "topic-docs")
    return topics.embedding_topics(docs, k=TOPICS_ON_VECTORS).select("seq", "topic", F.round("topic_prob", 4).alias("topic_prob"))


# --- segments --------------------------------------------------------------------------------

FEATURES = list(FEATURE_HEADERS)
Z = [f"{c}_z" for c in FEATURES]


def standard_features(t: Inputs):
    # answers are coded once and dealt to all cores: their file may be too small to be read by more than one task
    coded = survey.encode(answers(t)).select("respondent_id", *FEATURES).repartition(t.spark.sparkContext.defaultParallelism)
    filled = segments.impute_median(materialize(coded, "coded-answers"), FEATURES)
    z = segments.standardize(filled, FEATURES)
    return materialize(z.select("respondent_id", *FEATURES, *Z), "segment-features")


def chosen(t: Inputs):
    z = standard_features(t)
    patterns = materialize(segments.distinct_vectors(z, Z), "segment-patterns")
    return z, segments.choose_k(patterns, Z)


@query("choose_k")
def _(t: Inputs):
    _z, choice = chosen(t)
    return t.spark.createDataFrame([(choice.k, choice.silhouette)], "k int, silhouette double")


@query("elbow_table")
def _(t: Inputs):
    _z, choice = chosen(t)
    return t.spark.createDataFrame(choice.elbow, "k int, inertia double, silhouette double")


@query("kmeans_segments")
def _(t: Inputs):
    z = standard_features(t)
    patterns = materialize(segments.distinct_vectors(z, Z), "segment-patterns")
    return segments.assign(z, segments.best_kmeans(patterns, Z, 3), Z).select("respondent_id", "segment")


@query(
    "kmeans_properties",
    f"""with e as ({ENCODED}) select k, count(*) as n_rows, true as cost_recomputed, true as nearest, true as by_size,
         true as centres_are_means, true as silhouette_recomputed from e, (values (2), (3), (4), (5), (6), (7)) ks(k) group by k""",
)
def _(t: Inputs):
    """What must hold for the model of every k, recomputed from the rows."""
    z, choice = chosen(t)
    found = []
    for model in choice.models:
        told = segments.assign(z, model, Z).withColumn("_near", kmeans.nearest(Z, model.centres)["distance"])
        told = materialize(told, "assigned")
        means = told.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in Z]).orderBy("segment").collect()
        order = sorted(range(len(model.centres)), key=lambda i: (-model.sizes[i], model.centres[i].tolist()))
        gap = max(abs(r[c] - model.centres[order[r["segment"]]][i]) for r in means for i, c in enumerate(Z))
        total = told.agg(F.sum("_near").alias("cost"), F.count(F.lit(1)).alias("n")).first()
        centre = F.create_map(*[F.lit(x) for r in means for x in (r["segment"], F.array(*[F.lit(r[c]) for c in Z]))])[F.col("segment")]
        own = sum(((F.col(c) - centre[i]) * (F.col(c) - centre[i]) for i, c in enumerate(Z)), F.lit(0.0))
        nearest = told.filter(own > F.col("_near") + 0.01).isEmpty()
        shown = segments.silhouette(told, Z).first()[0]
        found.append((
            model.k, total["n"], bool(abs(total["cost"] - model.cost) < 1e-6 * model.cost), nearest,
            [r["n"] for r in means] == sorted((r["n"] for r in means), reverse=True), bool(gap < 0.01), bool(abs(shown - model.silhouette) < 1e-6),
        ))
    return t.spark.createDataFrame(found, "k int, n_rows bigint, cost_recomputed boolean, nearest boolean, by_size boolean, centres_are_means boolean, silhouette_recomputed boolean")


@query("pca_2d")
def _(t: Inputs):
    return segments.pca_2d(standard_features(t), Z).select("respondent_id", "pc1", "pc2")
