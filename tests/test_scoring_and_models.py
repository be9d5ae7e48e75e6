import math
import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hearken.operators import kmeans, scoring, segments, survey, topics, vectors


@pytest.mark.parametrize(
    "values, mean, sd", [([], None, None), ([0.8], 0.8, None), ([0.7, 0.8, 0.9], 0.8, 0.1), ([0.5, 0.5, 0.5], 0.5, 0.0)]
)
def test_fidelity_summary(spark, values, mean, sd):
    data = [("s", v) for v in values] or [("s", None)]
    got = scoring.fidelity_summary(spark.createDataFrame(data, "segment string, fidelity double"), "segment").first()
    assert (got["mean"], got["sd"], got["n_trials"]) == (mean, sd, len(values))


def test_distributions(spark):
    dist = spark.createDataFrame(
        [("a", "1", 2.0), ("a", "2", 6.0), ("b", "1", -1.0), ("b", "2", 3.0), ("c", "1", 0.0)], "segment string, category string, weight double"
    )
    scaled = scoring.normalized(dist, ["segment"])
    assert rows(scaled, "segment", "category", "p") == [("a", "1", 0.25), ("a", "2", 0.75)]
    seen = spark.createDataFrame([("a", "2", 0.5), ("a", "3", 0.5)], "segment string, category string, q double")
    scored = scoring.total_variation(scoring.aligned(scaled.drop("weight"), seen, ["segment"]), ["segment"]).first()
    assert (scored["tvd"], scored["fidelity"]) == (0.5, 0.5)


def test_holdout_rounds_half_even_and_counts_fractions(spark):
    m = spark.createDataFrame([(0, 2.5), (0, 2.0), (0, 3.5), (0, None)], "segment int, a double")
    got = rows(scoring.holdout_distribution(m, "a"), "category", "n", "fractional_n", "share")
    assert got == [(2, 2, 1, 0.6667), (4, 1, 1, 0.3333)]


def test_question_columns(spark):
    assert survey.column_of(["1. 가전", "13. 지불", "13-1. 걱정"], "q13") == "13. 지불"
    for headers in (["2. x"], ["1. a", "1. b"]):
        with pytest.raises(KeyError):
            survey.column_of(headers, "q1")


def test_tfidf_against_the_formula(spark):
    docs = ["red green blue red", "red blue", "green green", "blue sky red"]
    df = spark.createDataFrame(list(enumerate(docs)), "seq long, tokens string")
    grams = []
    for d in docs:
        w = [x for x in d.split() if len(x) > 1]
        grams.append(Counter(w + [" ".join(p) for p in zip(w, w[1:])]))
    df_of = Counter(t for g in grams for t in g)
    want = {}
    for i, g in enumerate(grams):
        w = {t: n * (math.log((1 + len(docs)) / (1 + df_of[t])) + 1) for t, n in g.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        want.update({(i, t): x / length for t, x in w.items()})
    got = {(r["seq"], r["term"]): r["tfidf"] for r in vectors.tfidf(df).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    few = {r["term"] for r in vectors.tfidf(df, max_terms=2).collect()}
    assert few == {"red", "blue"} or few == {"red", "green"}


def test_embedding_check(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "b")], "seq long, review string")
    def check(vecs, **kw):
        v = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
        return vectors.embedding_check(docs, v, **kw).first()["usable"]

    good = [(0, [1.0, 2.0]), (1, [0.0, 1.0])]
    assert check(good)
    assert not check(good[:1])
    assert not check([(0, [1.0, 2.0]), (1, [0.0])])
    assert not check([(0, [1.0, float("nan")]), (1, [0.0, 1.0])])
    recorded = vectors.embedding_manifest(docs, spark.createDataFrame(good, "vec_id long, embedding array<float>")).first().asDict()
    assert check(good, recorded=recorded)
    assert not check(good, recorded={**recorded, "document_hash": "x"})
    assert not check(good, recorded={**recorded, "model": "other"})


def test_planted_groups_are_found_and_numbered_by_size(spark):
    centres = [(1.0, 5.0, 2.0), (4.0, 1.0, 2.0), (2.5, 3.0, 9.0)]
    planted = [(i, *(c + (i * 7 % 5 - 2) * 0.1 for c in centres[0 if i % 20 < 9 else 1 if i % 20 < 15 else 2])) for i in range(300)]
    drawn = spark.createDataFrame(planted, "id long, a double, b double, c double")
    features = [c for c in drawn.columns if c != "id"]
    z = segments.standardize(segments.impute_median(drawn, features), features)
    zs = [f"{c}_z" for c in features]
    means = z.agg(*[F.avg(c) for c in zs], *[F.stddev_pop(c) for c in zs]).first()
    assert all(abs(m) < 1e-9 for m in means[: len(zs)]) and all(abs(s - 1) < 1e-9 for s in means[len(zs):])
    patterns = segments.distinct_vectors(z, zs)
    choice = segments.choose_k(patterns, zs, k_max=4, restarts=2)
    assert choice.k in (2, 3) and [e[0] for e in choice.elbow] == [2, 3, 4]
    sizes = {r["segment"]: r["n"] for r in segments.sizes(segments.assign(z, choice.model, zs)).collect()}
    assert sum(sizes.values()) == 300 and sizes[0] == max(sizes.values())


def test_models_fitted_together_cost_no_more_than_single_fits(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(9)
    data = [tuple(rng.gauss(rng.choice([0, 4, 9]), 1.0) for _ in range(3)) + (float(rng.randrange(1, 4)),) for _ in range(400)]
    rows = spark.createDataFrame([*data, (None, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 0.0)], "a double, b double, c double, weight double")
    names = ["a", "b", "c"]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("together", "together")
    models = kmeans.judged(rows, names, kmeans.fit(rows, names, [(k, seed) for k in (2, 3, 5) for seed in range(6)]))
    assert len(tracker.getJobIdsForGroup("together")) <= 60  # two jobs a pass, whatever the number of models
    spark.sparkContext.setJobGroup("plain", "plain")
    wide = VectorAssembler(inputCols=names, outputCol="x").transform(spark.createDataFrame(data, "a double, b double, c double, weight double"))
    for k in (2, 3, 5):
        best = min((m for m in models if m.k == k), key=lambda m: m.cost)
        plain = min(KMeans(k=k, seed=s, featuresCol="x", weightCol="weight").fit(wide).summary.trainingCost for s in range(3))
        assert best.cost <= plain * 1.001 and abs(best.sizes.sum() - sum(d[3] for d in data)) < 1e-6
    with pytest.raises(ValueError):
        kmeans.fit(rows.limit(0), names, [(2, 0)])
    few = kmeans.judged(rows.limit(2), names, kmeans.fit(rows.limit(2), names, [(3, 0)]))[0]
    assert few.cost < 1e-9 and len(few.centres) <= 2


def test_constant_column_standardises_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    assert {r["b_z"] for r in segments.standardize(df, ["a", "b"]).collect()} == {0.0}


def test_topic_models(spark):
    text = ["connect server error wifi", "server down connect again", "register device lost reset", "reset register lost again"]
    docs = spark.createDataFrame([(i, text[i % 4]) for i in range(40)], "seq long, tokens string")
    assigned, table = topics.lda_topics(docs, iterations=5)
    assert assigned.count() == 40 and table.filter("word_rank = 1").count() == topics.lda_topic_count(40)
    assert assigned.filter(F.col("topic_label").startswith("T")).count() == 40
    with pytest.raises(ValueError):
        topics.lda_topics(docs.limit(3))
    vecs = [(i, [float(i % 2) * 10 + i * 0.001, 1.0]) for i in range(40)] + [(40, [500.0, 500.0])]
    points = spark.createDataFrame(vecs, "seq long, embedding array<double>")
    found = {r["seq"]: r["topic"] for r in topics.embedding_topics(points, k=3).collect()}
    assert found[40] == -1 and found[0] != found[1] and found[0] == found[2]


def test_null_category_rejects_the_answer(spark):
    answers = [(1, '{"1": 2, "2": null}'), (2, '{"1": 2}'), (3, '{"1": "x"}'), (4, "no json")]
    got = scoring.parsed_answers(spark.createDataFrame(answers, "id int, answer string"), "answer", (1, 2)).collect()
    assert {r["id"]: r["distribution"] for r in got} == {1: None, 2: {"1": 1.0, "2": 0.0}, 3: None, 4: None}


def test_terms_are_counted_per_key_across_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(1, "ab cd ab"), (1, "cd ab cd"), (None, "ab"), (None, "ab ef"), (2, None), (3, ""), (4, "cd ab")]
    docs = spark.createDataFrame(rows, "seq bigint, tokens string")
    try:
        for size in (1, 2, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = {(r["seq"], r["term"]): r["tf"] for r in vectors.doc_terms(docs).collect()}
            assert found == {
                (1, "ab"): 3, (1, "cd"): 3, (1, "ab cd"): 2, (1, "cd ab"): 2, (None, "ab"): 2, (None, "ef"): 1,
                (None, "ab ef"): 1, (4, "cd"): 1, (4, "ab"): 1, (4, "cd ab"): 1,
            }
            totals = {r["term"]: (r["corpus_tf"], r["df"]) for r in vectors.term_totals(docs).collect()}
            assert totals == {"ab": (6, 3), "cd": (4, 2), "ef": (1, 1), "ab cd": (2, 1), "cd ab": (3, 2), "ab ef": (1, 1)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_bounded_vocabularies_do_not_shuffle_the_terms(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, "ab")], "seq bigint, tokens string")
    plan = vectors.tfidf(docs, max_terms=2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(seq" in plan
    assert "hashpartitioning(term" in vectors.tfidf(docs)._jdf.queryExecution().executedPlan().toString()
