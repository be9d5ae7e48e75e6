"""Document vectors as long tables: term counts, TF-IDF, embeddings joined by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.functions import hashing, text
from hearken.functions.fixed_values import EMBEDDING_MODEL, SMALL_CORPUS, TFIDF_TOP
from hearken.functions.numeric import round_even


BROADCAST_TERMS = 100_000  # terms of a vocabulary that every task may hold


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by seq in pieces that never cut a document: the last one of a piece waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        seq = batch.column("seq")
        if held and batch.num_rows and held[-1].column("seq")[-1] != seq[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = batch.num_rows
        while last and seq[last - 1] == seq[batch.num_rows - 1]:
            last -= 1
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        if last < batch.num_rows:
            held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def count_piece(piece: pa.Table, pairs: bool) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """(document, term, seq of the documents, tf, terms): one entry a document and term, both as numbers."""
    seq, runs = pa.concat_arrays(piece.column("seq").chunks), pa.concat_arrays(piece.column("run").chunks)
    runs = pc.split_pattern(pc.if_else(pc.equal(runs, ""), pa.scalar(None, runs.type), runs), " ")
    sizes = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
    words = runs.flatten().dictionary_encode()
    code, known = words.indices.to_numpy().astype(np.int64), words.dictionary
    same = np.array([i > 0 and seq[i] == seq[i - 1] for i in range(len(seq))], bool)  # rows of one document follow each other
    document = np.cumsum(~same) - 1
    row = np.repeat(np.arange(len(seq)), sizes)
    owner = document[row]
    if pairs:
        ahead = np.flatnonzero(row[1:] == row[:-1])
        both, pair = np.unique(code[ahead] * len(known) + code[ahead + 1], return_inverse=True)
        joined = pc.binary_join_element_wise(known.take(pa.array(both // max(len(known), 1))), known.take(pa.array(both % max(len(known), 1))), " ")
        owner, code = np.concatenate([owner, owner[ahead]]), np.concatenate([code, pair + len(known)])
        known = pa.concat_arrays([known, joined])
    entries, tf = np.unique(owner * max(len(known), 1) + code, return_counts=True)
    return entries // max(len(known), 1), entries % max(len(known), 1), seq.take(pa.array(np.flatnonzero(~same))), tf, known


def _counted(df: DataFrame, content: str, pairs: bool, schema: str, shape: Callable) -> DataFrame:
    """`shape` of the counts of every piece.

    The words are shuffled once, by document. A document is counted where it is read, so neither the exploded words nor
    a hash table of a whole partition exist; memory is bounded by a batch of words and the words of one document.
    """
    # words are found before the shuffle, so that the regular expression runs once per document; none holds a space
    words = F.array_join(text.words(F.col(content)), " ").alias("run")
    placed = df.select("seq", words).repartition("seq").sortWithinPartitions("seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in whole_documents(batches):
            yield shape(*count_piece(piece, pairs))

    return placed.mapInArrow(run, schema)


def doc_terms(df: DataFrame, content: str = "tokens", pairs: bool = True) -> DataFrame:
    """(seq, term, tf) of every document, with word pairs when `pairs`."""

    def shape(document, term, seq, tf, terms) -> pa.RecordBatch:
        cells = [seq.take(pa.array(document)), terms.take(pa.array(term)), pa.array(tf, pa.int64())]
        return pa.RecordBatch.from_arrays(cells, ["seq", "term", "tf"])

    kind = df.schema["seq"].dataType.simpleString()
    return _counted(df, content, pairs, f"seq {kind}, term string, tf bigint", shape)


def term_totals(df: DataFrame, content: str = "tokens", pairs: bool = True) -> DataFrame:
    """(term, corpus_tf, df) over all documents; tasks hand on one row a term and batch."""

    def shape(document, term, seq, tf, terms) -> pa.RecordBatch:
        n = len(terms)
        cells = [pa.array(np.bincount(term, tf, n).astype(np.int64)), pa.array(np.bincount(term, minlength=n).astype(np.int64))]
        return pa.RecordBatch.from_arrays([terms, *cells], ["term", "corpus_tf", "df"])

    parts = _counted(df, content, pairs, "term string, corpus_tf bigint, df bigint", shape)
    return parts.groupBy("term").agg(F.sum("corpus_tf").alias("corpus_tf"), F.sum("df").alias("df"))


def corpus_size(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def published_min_df(n_docs: Column) -> Column:
    """The published rule: small corpora keep words that occur once. Operators take it only as an argument."""
    return F.when(n_docs < SMALL_CORPUS, F.lit(1)).otherwise(F.lit(2))


def frequent(totals: DataFrame, max_terms: int | None = None, least_df: int | Column = 1) -> DataFrame:
    """Of (term, corpus_tf, df), the terms of at least `least_df` documents; with `max_terms` only the most frequent."""
    found = totals.filter(F.col("df") >= least_df)
    return found if max_terms is None else found.orderBy(F.desc("corpus_tf"), "term").limit(max_terms)


def vocabulary(terms: DataFrame, max_terms: int | None = None, least_df: int | Column = 1) -> DataFrame:
    """All terms of at least `least_df` documents with their frequencies; with `max_terms` only the most frequent."""
    return frequent(terms.groupBy("term").agg(F.sum("tf").alias("corpus_tf"), F.count(F.lit(1)).alias("df")), max_terms, least_df)


def of_vocabulary(terms: DataFrame, vocab: DataFrame, max_terms: int | None) -> DataFrame:
    """The terms that the vocabulary holds; one of bounded size goes to the terms, so that these are not shuffled."""
    small = max_terms is not None and max_terms <= BROADCAST_TERMS
    return terms.join(F.broadcast(vocab) if small else vocab, "term")


def count_vectors(
    df: DataFrame, max_terms: int | None = None, least_df: int | Column = 1, content: str = "tokens"
) -> DataFrame:
    vocab = frequent(term_totals(df, content, pairs=False), max_terms, least_df).select("term")
    return of_vocabulary(doc_terms(df, content, pairs=False), vocab, max_terms).select("seq", "term", "tf")


def tfidf(
    df: DataFrame, content: str = "tokens", max_terms: int | None = None, least_df: int | Column = 1
) -> DataFrame:
    """(seq, term, tf, tfidf): smoothed idf, rows of length one, over all terms unless limits are given."""
    n_docs = corpus_size(df)
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    vocab = frequent(term_totals(df, content), max_terms, least_df).select("term", idf.alias("idf"))
    weighted = of_vocabulary(doc_terms(df, content), vocab, max_terms).withColumn("w", F.col("tf") * F.col("idf"))
    # one document's distinct terms, however many documents there are
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("seq")))
    return weighted.select("seq", "term", "tf", (F.col("w") / length).alias("tfidf"))


def top_terms(weights: DataFrame, n: int = TFIDF_TOP) -> DataFrame:
    """Terms by summed weight."""
    scored = weights.groupBy("term").agg(round_even(F.sum("tfidf"), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "term").limit(n)


def usable_vector(vector: Column) -> Column:
    """A non-empty vector without NaN or infinity."""
    broken = F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (F.size(vector) > 0) & ~broken


def embedding_check(
    docs: DataFrame,
    vectors: DataFrame,
    recorded: dict[str, object] | None = None,
    model: str = EMBEDDING_MODEL,
) -> DataFrame:
    """One row: may these vectors be used for these documents?

    Vectors are matched by key. Counts, key coverage, dimension, finiteness and, when a manifest
    was recorded, model name and document hash all have to agree; otherwise the caller goes on
    without vectors.
    """
    seen = docs.select("seq", "review").join(vectors, F.col("seq") == F.col("vec_id"), "full_outer")
    good = F.col("embedding").isNotNull() & usable_vector(F.col("embedding"))
    dims = F.size("embedding")
    report = seen.agg(
        F.count("seq").alias("n_docs"),
        F.count("vec_id").alias("n_vectors"),
        F.count_if(F.col("seq").isNotNull() & F.col("vec_id").isNotNull()).alias("n_matched"),
        F.count_if(F.col("vec_id").isNotNull() & ~good).alias("n_broken"),
        F.min(F.when(F.col("vec_id").isNotNull(), dims)).alias("min_dim"),
        F.max(F.when(F.col("vec_id").isNotNull(), dims)).alias("max_dim"),
    )
    usable = (
        (F.col("n_docs") == F.col("n_matched"))
        & (F.col("n_vectors") == F.col("n_matched"))
        & (F.col("n_broken") == 0)
        & (F.col("min_dim") == F.col("max_dim"))
    )
    if recorded is not None:
        doc_hash = hashing.fingerprint(docs, ["seq", "review"]).select("content_hash").scalar()
        usable = (
            usable
            & F.lit(recorded.get("model") == model)
            & (doc_hash == F.lit(recorded.get("document_hash")))
            & (F.col("n_docs") == F.lit(recorded.get("row_count")))
        )
    return report.withColumn("usable", usable)


REFUSALS = (
    "not_available", "model_differs", "document_hash_differs", "row_count_differs", "vectors_missing", "vectors_left_over",
    "broken_vectors", "dimensions_differ",
)


def judge_embeddings(docs: DataFrame, vectors: DataFrame, manifests: DataFrame, model: str = EMBEDDING_MODEL) -> DataFrame:
    """`manifests` with the columns `refused` (the first rule that speaks against its vectors) and `usable`.

    A manifest has sbert_available, sbert_model, document_hash and row_count as they were recorded. The documents and vectors are
    looked at once, in scalar subqueries, however many manifests there are.
    """
    now = hashing.fingerprint(docs, ["seq", "review"]).select(F.struct("content_hash", "row_count")).scalar()
    seen = embedding_check(docs, vectors).select(F.struct("*")).scalar()
    told = manifests.withColumn("_now", now).withColumn("_seen", seen)
    broken = {
        "not_available": ~F.col("sbert_available").eqNullSafe(True),
        "model_differs": ~F.col("sbert_model").eqNullSafe(model),
        "document_hash_differs": ~F.col("document_hash").eqNullSafe(F.col("_now.content_hash")),
        "row_count_differs": ~F.col("row_count").eqNullSafe(F.col("_now.row_count")),
        "vectors_missing": F.col("_seen.n_matched") < F.col("_seen.n_docs"),
        "vectors_left_over": F.col("_seen.n_matched") < F.col("_seen.n_vectors"),
        "broken_vectors": F.col("_seen.n_broken") > 0,
        "dimensions_differ": ~F.col("_seen.min_dim").eqNullSafe(F.col("_seen.max_dim")),
    }
    refused = F.coalesce(*[F.when(broken[r], F.lit(r)) for r in REFUSALS])
    return told.withColumn("refused", refused).withColumn("usable", F.col("refused").isNull()).drop("_now", "_seen")


def document_features(docs: DataFrame, vectors: DataFrame, manifest: DataFrame, model: str = EMBEDDING_MODEL, **limits) -> DataFrame:
    """(seq, engine, feature, value): the vectors' components if the one manifest admits them, else TF-IDF weights of words.

    The choice is a scalar subquery, made when the plan runs: either branch is filtered by it. Without a manifest, and
    with more than one, the words are taken. `limits` go to `tfidf`; documents need tokens for it.
    """
    judged = judge_embeddings(docs, vectors, manifest, model)
    admitted = judged.agg((F.count(F.lit(1)) == 1) & F.coalesce(F.bool_and("usable"), F.lit(False)))
    parts = with_embeddings(docs.select("seq"), vectors).select("seq", F.posexplode("embedding").alias("at", "value"))
    by_vector = parts.select(
        "seq", F.lit("vectors").alias("engine"), F.concat(F.lit("d"), F.col("at").cast("string")).alias("feature"), F.col("value").cast("double").alias("value")
    )
    # admitted vectors leave no document to count; a filter after the counting would come too late
    asked = docs.filter(~admitted.scalar())
    by_word = tfidf(asked, **limits).select("seq", F.lit("words").alias("engine"), F.col("term").alias("feature"), F.col("tfidf").alias("value"))
    return by_vector.filter(admitted.scalar()).unionByName(by_word)


def embedding_manifest(docs: DataFrame, vectors: DataFrame, model: str = EMBEDDING_MODEL) -> DataFrame:
    """Document hash, row count, model and availability."""
    available = vectors.agg(F.count(F.lit(1)) > 0).scalar()
    return hashing.fingerprint(docs, ["seq", "review"]).select(
        F.col("content_hash").alias("document_hash"),
        "row_count",
        F.when(available, F.lit(model)).alias("model"),
        available.alias("available"),
    )


def with_embeddings(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Attach vectors by document key."""
    keyed = vectors.select(F.col("vec_id").alias("seq"), "embedding")
    return docs.join(keyed, "seq")
