"""Topic models on negative reviews."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.functions import text
from hearken.functions.fixed_values import (
    COUNT_TERMS,
    LDA_SEED,
    LDA_TOPICS,
    MIN_NEGATIVES,
    MIN_TOPIC_SIZE,
    NOISE_TOPIC,
    TOPIC_LABEL_WORDS,
    TOPICS_ON_VECTORS,
)
from hearken.operators.cleaning import top_per_key
from hearken.operators.vectors import corpus_size, doc_terms, published_min_df, vocabulary


def lda_topic_count(n_docs: int, requested: int = LDA_TOPICS) -> int:
    """The published number of topics of a corpus."""
    return min(requested, max(2, n_docs // 10))


def lda_topics(
    negatives: DataFrame,
    content: str = "tokens",
    k: int | None = None,
    seed: int = LDA_SEED,
    iterations: int = 20,
    max_terms: int = COUNT_TERMS,
) -> tuple[DataFrame, DataFrame]:
    """Assign every document its most likely topic; also return the labelled topic table.

    Without `k` the published number of topics is taken. The vocabulary (at most `max_terms` words) and the topic-word matrix are model parameters and
    live on the driver, the documents do not.
    """
    spark = negatives.sparkSession
    n_docs = negatives.count()
    if n_docs < MIN_NEGATIVES:
        raise ValueError(f"{n_docs} negative reviews, at least {MIN_NEGATIVES} are needed")
    terms = doc_terms(negatives, content, pairs=False)
    words = [r["term"] for r in vocabulary(terms, max_terms, published_min_df(corpus_size(negatives))).collect()]
    counter = CountVectorizerModel.from_vocabulary(words, inputCol="_words", outputCol="_tf")
    counted = counter.transform(negatives.withColumn("_words", text.words(F.col(content))))
    model = LDA(
        k=k or lda_topic_count(n_docs), seed=seed, maxIter=iterations, featuresCol="_tf"
    ).fit(counted.select("seq", "_tf"))
    strongest = model.describeTopics(TOPIC_LABEL_WORDS).collect()
    labels = {
        r["topic"]: "_".join([f"T{r['topic']}", *[words[i] for i in r["termIndices"]]])
        for r in strongest
    }
    weights = vector_to_array("topicDistribution")
    top = F.array_max(weights)
    named = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    assigned = (
        model.transform(counted)
        .withColumn("topic", (F.array_position(weights, top) - 1).cast("int"))
        .withColumn("topic_prob", top)
        .withColumn("topic_label", named[F.col("topic")])
        .drop("_words", "_tf", "topicDistribution")
    )
    table = spark.createDataFrame(
        [
            (int(r["topic"]), labels[r["topic"]], rank + 1, words[i], float(w))
            for r in strongest
            for rank, (i, w) in enumerate(zip(r["termIndices"], r["termWeights"]))
        ],
        "topic int, topic_label string, word_rank int, word string, weight double",
    )
    return assigned, table


def topic_words(
    df: DataFrame, topic: str = "topic", content: str = "tokens", n: int = TOPIC_LABEL_WORDS
) -> DataFrame:
    """The strongest words of every topic by class TF-IDF: word count in the topic times
    ln(1 + mean words per topic / count of the word anywhere)."""
    words = df.select(topic, F.explode(text.words(F.col(content))).alias("word"))
    in_topic = words.groupBy(topic, "word").agg(F.count(F.lit(1)).alias("tf"))
    overall = in_topic.groupBy("word").agg(F.sum("tf").alias("everywhere"))
    mean_words = in_topic.agg(F.sum("tf") / F.count_distinct(topic)).scalar()
    weight = F.col("tf") * F.log(F.lit(1.0) + mean_words / F.col("everywhere"))
    weighted = in_topic.join(overall, "word").withColumn("weight", weight)
    return top_per_key(weighted, [topic], [F.desc("weight"), F.col("word")], n).select(
        topic, "word", "tf", "weight"
    )


def topic_labels(words: DataFrame, topic: str = "topic") -> DataFrame:
    """`<topic>_w1_w2_w3_w4`, strongest word first; a topic has only its top words here."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "word")))
    names = F.transform(ranked, lambda x: x["word"])
    return words.groupBy(topic).agg(
        F.concat_ws("_", F.col(topic).cast("string"), F.array_join(names, "_")).alias("topic_label")
    )


def embedding_topics(
    negatives: DataFrame,
    k: int = TOPICS_ON_VECTORS,
    seed: int = LDA_SEED,
    min_size: int = MIN_TOPIC_SIZE,
    far: float = 3.0,
) -> DataFrame:
    """Topics on supplied vectors: k-means, then outliers and small clusters become noise.

    Spark has no density clustering. Every document goes to its nearest centre; a document more
    than `far` deviations beyond the mean distance of its cluster, and every cluster that keeps
    fewer than `min_size` documents, is marked -1.
    """
    vectors = negatives.withColumn("x", array_to_vector(F.col("embedding").cast("array<double>")))
    n_docs = vectors.count()
    if n_docs < MIN_NEGATIVES:
        raise ValueError(f"{n_docs} negative reviews, at least {MIN_NEGATIVES} are needed")
    model = KMeans(k=k, seed=seed, featuresCol="x").fit(vectors)
    centres = F.create_map(
        *[
            item
            for i, c in enumerate(model.clusterCenters())
            for item in (F.lit(i), F.lit([float(v) for v in c]))
        ]
    )
    gap = F.zip_with(
        F.col("embedding").cast("array<double>"),
        centres[F.col("cluster")],
        lambda a, b: (a - b) * (a - b),
    )
    placed = (
        model.transform(vectors)
        .withColumnRenamed("prediction", "cluster")
        .withColumn("distance", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v)))
        .drop("x")
    )
    spread = placed.groupBy("cluster").agg(
        (F.avg("distance") + F.lit(far) * F.stddev_pop("distance")).alias("reach")
    )
    # k rows
    kept = placed.join(F.broadcast(spread), "cluster").withColumn(
        "near", F.col("distance") <= F.col("reach")
    )
    sizes = kept.groupBy("cluster").agg(F.count_if("near").alias("size"))
    real = F.col("near") & (F.col("size") >= min_size)
    return (
        kept.join(F.broadcast(sizes), "cluster")
        .withColumn("topic", F.when(real, F.col("cluster")).otherwise(F.lit(NOISE_TOPIC)))
        .withColumn("topic_prob", F.lit(1.0) / (F.lit(1.0) + F.col("distance")))
        .drop("cluster", "distance", "reach", "near", "size")
    )
