"""Hard negatives by Kronecker-packed products.

Components are whole numbers, floor(scale * x). Every component of the anchors and of the candidates is biased by the least
one of its block, so that none is negative and an inner product of `size` components stays below 2**width. Components of
`fields` candidates are then packed into one wide integer, `width` bits apart. Multiplying a packed component by that of
an anchor multiplies all its candidates at once, and since no field can overflow, the sum over the components holds
`fields` exact products, which are cut out by shifts and masks; the biases are taken off again by the sums of either
side. The wide integer lives in the 53 exact bits of a double, so that the multiplications are one matrix product; where a
single field is wider than that, it is a Python integer of any size, with the same packing. Both are exact.

Anchors are taken in blocks of at most `BLOCK`, which the tasks receive whole; the candidates are read in place, in record
batches, and never shuffled. A task keeps the best few candidates for every anchor, and the best of all tasks are chosen
by a window over those few. A first pass finds the positives, a second one the negatives between the limits that they
set. So there is no join of pairs, whatever the share of one label.

Defined results: rows with a null id, label or vector, or with a null or non-finite component (also after scaling), take no
part. Rows that agree in id, label and vector are one row; rows that share an id only are rows of their own, but never
each other's positive. Vectors of unlike lengths are not compared; empty vectors have product 0 with each other. An anchor
without positives, and a positive without negatives between its limits (always so below zero), gives no row. A product
beyond 64 bits is an error. Further columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearken.session import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LIMITS = (50, 95)  # per cent of the positive's score
BLOCK = 32768  # anchors handed to a task at once
TILE = 1024  # anchors multiplied at once
ROWS = 2048  # candidates multiplied at once
EXACT_BITS = 53
BIG_FIELDS = 8

Best = tuple[np.ndarray, np.ndarray, np.ndarray]  # owner, score, id


def whole(values: np.ndarray) -> np.ndarray:
    """Floored doubles as 64-bit integers, or as Python integers where those do not fit."""
    if not values.size or np.abs(values).max() < 2.0**52:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


class Packed:
    """The components of one block of candidates, `fields` of them in one wide integer."""

    def __init__(self, rows: np.ndarray, least_a: int, range_a: int):
        n, self.size = rows.shape
        self.n, self.low = n, int(rows.min())
        most = max(1, self.size * range_a * (int(rows.max()) - self.low))
        self.width = most.bit_length()
        self.fields = EXACT_BITS // self.width or BIG_FIELDS
        high = max(abs(least_a), abs(least_a + range_a)) * max(abs(self.low), abs(int(rows.max()))) * self.size
        self.small = self.width <= EXACT_BITS and high < 1 << 62  # else in Python's integers
        rows = rows if self.small else rows.astype(object)
        words = -(-n // self.fields)
        padded = np.zeros((words * self.fields, self.size), rows.dtype)
        padded[:n] = rows - self.low
        lanes = padded.reshape(self.fields, words, self.size)
        self.words = lanes[0].copy()
        for i in range(1, self.fields):
            self.words = self.words + (lanes[i] << (self.width * i))
        self.sums = rows.sum(axis=1)
        self.least_a = least_a

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors down and candidates across."""
        anchors = anchors if self.small else anchors.astype(object)
        biased = anchors - self.least_a
        if self.small:
            product = (biased.astype(np.float64) @ self.words.astype(np.float64).T).astype(np.int64)
        else:
            product = biased @ self.words.T
        mask = (1 << self.width) - 1
        found = np.concatenate([(product >> (self.width * i)) & mask for i in range(self.fields)], axis=1)[:, : self.n]
        return found + self.low * anchors.sum(axis=1)[:, None] + self.least_a * (self.sums - self.size * self.low)[None, :]


def packed(rows: np.ndarray, anchors: np.ndarray) -> Packed:
    low = int(anchors.min())
    return Packed(rows, low, int(anchors.max()) - low)


def products(rows: np.ndarray, anchors: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function from anchors (some of the given ones) to their scores with `rows`."""
    if not rows.shape[1]:
        return lambda some: np.zeros((len(some), len(rows)), np.int64)
    return packed(rows, anchors).scores


def best(found: Best, k: int) -> Best:
    """The first k of every owner, higher scores first, then smaller ids."""
    owner, score, ident = found
    order = np.argsort(ident, kind="stable")
    order = order[np.argsort(-score[order], kind="stable")]
    order = order[np.argsort(owner[order], kind="stable")]
    owner = owner[order]
    first = np.searchsorted(owner, owner)
    keep = order[np.arange(len(owner)) - first < k]
    return found[0][keep], score[keep], ident[keep]


class Heap:
    """The best k candidates of every owner so far, and the score that a further one has to reach."""

    def __init__(self, owners: int, k: int):
        self.k, self.floor = k, np.full(owners, np.iinfo(np.int64).min, np.int64)
        self.kept: Best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, found: Best) -> None:
        if not len(found[0]):
            return
        joined = [np.concatenate([a, b]) for a, b in zip(self.kept, found)]
        self.kept = best((joined[0], joined[1], joined[2]), self.k)
        owner, score, _ = self.kept
        if len(owner) >= self.k:
            full = np.flatnonzero(owner[self.k - 1 :] == owner[: len(owner) - self.k + 1])
            self.floor[owner[full]] = score[full + self.k - 1]


class Anchors:
    """One block of anchors, those of equal vector length together."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[list[float]]):
        self.ids, self.labels = ids, labels
        self.sizes = np.array([len(v) for v in vectors], np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for size in np.unique(self.sizes).tolist():
            some = [v for v in vectors if len(v) == size]
            self.rows[size] = whole(np.array(some, np.float64).reshape(len(some), size))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, components) of rows with equal vector length, at most ROWS at once."""
    for batch in batches:
        vectors = batch.column(2)
        sizes = vectors.value_lengths().to_numpy()
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            for start in range(0, len(at), ROWS):
                part = batch.take(pa.array(at[start : start + ROWS]))
                rows = part.column(2).flatten().to_numpy().reshape(part.num_rows, size)
                yield part.column(0).to_numpy(), part.column(1).to_numpy(), whole(rows)


def pick(heap: Heap, owners: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, lows: np.ndarray) -> None:
    """Adds the allowed candidates that reach the floors of their owners; `scores` has a row for every owner."""
    at, of = np.nonzero(allowed & (scores >= np.maximum(lows, heap.floor[owners])[:, None]))
    heap.add((owners[at], scores[at, of], ids[of]))


def best_of_tasks(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def positives_of(rows: DataFrame, block: Anchors, k: int) -> DataFrame:
    """(anchor, id, score, rank): the first k other rows with the label of every anchor (its number in the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = Heap(len(block.ids), k)
        for ids, labels, comps in chunks(batches):
            own = np.flatnonzero(block.sizes == comps.shape[1])
            if not len(own):
                continue
            of = products(comps, block.rows[comps.shape[1]])
            for start in range(0, len(own), TILE):
                part = own[start : start + TILE]
                scores = of(block.rows[comps.shape[1]][start : start + TILE])
                allowed = (block.labels[part][:, None] == labels) & (block.ids[part][:, None] != ids)
                pick(heap, part, scores, ids, allowed, scores.min(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.int64()) for x in heap.kept], ["anchor", "score", "id"])

    return best_of_tasks(rows.mapInArrow(run, "anchor bigint, score bigint, id bigint"), ["anchor"], k)


def negatives_of(rows: DataFrame, block: Anchors, pairs: np.ndarray, k: int, limits: tuple[int, int]) -> DataFrame:
    """(pair, id, score, rank) for `pairs`, whose rows are the anchor's number and the positive's score, by anchor."""
    low, high = limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = Heap(len(pairs), k)
        for ids, labels, comps in chunks(batches):
            own = np.flatnonzero(block.sizes == comps.shape[1])
            if not len(own):
                continue
            of = products(comps, block.rows[comps.shape[1]])
            for start in range(0, len(own), TILE):
                part = own[start : start + TILE]
                scores = of(block.rows[comps.shape[1]][start : start + TILE])
                other = block.labels[part][:, None] != labels
                first, last = np.searchsorted(pairs[:, 0], part), np.searchsorted(pairs[:, 0], part, "right")
                for nth in range(int((last - first).max(initial=0))):
                    line = np.flatnonzero(first + nth < last)
                    owners = first[line] + nth
                    marks = pairs[owners, 1].astype(scores.dtype)
                    some = scores[line]
                    allowed = other[line] & (100 * some <= high * marks[:, None])
                    pick(heap, owners, some, ids, allowed, -(-low * marks // 100))
        yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.int64()) for x in heap.kept], ["pair", "score", "id"])

    return best_of_tasks(rows.mapInArrow(run, "pair bigint, score bigint, id bigint"), ["pair"], k)


def mine(
    rows: DataFrame,
    is_anchor: str | Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    limits: tuple[int, int] = LIMITS,
    block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); `is_anchor` is a condition on `rows`."""
    spark = rows.sparkSession
    mark = F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor
    comps = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    fits = F.forall("comps", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), comps.alias("comps"), mark.alias("anchor")
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("comps").isNotNull() & fits)
    floored = F.transform("comps", lambda x: floor_double(x))
    ready = materialize(
        usable.select("id", "label", floored.alias("comps"), F.coalesce("anchor", F.lit(False)).alias("anchor")).distinct(), "negatives"
    )
    candidates = ready.select("id", "label", "comps")
    heads = ready.filter("anchor").select("id", "label", "comps")
    count = heads.count()
    blocks = -(-count // block)
    spread = F.pmod(F.xxhash64("id", "label", "comps"), F.lit(max(1, 2 * blocks - 1)))  # about half a block in each
    done = []
    for number in range(max(1, 2 * blocks - 1)):
        part = heads.filter(spread == number).toArrow() if count else None
        for start in range(0, part.num_rows if part else 0, block):
            done.append(mine_block(candidates, part.slice(start, block), positives, negatives, limits))
    empty = spark.createDataFrame(
        [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    )
    for one in done:
        empty = empty.unionByName(one)
    return empty


def floor_double(x: Column) -> Column:
    """floor as a double of any size: from 2**53 on doubles are whole anyway."""
    return F.when(F.abs(x) < 2.0**53, F.floor(F.when(F.abs(x) < 2.0**53, x).otherwise(F.lit(0.0))).cast("double")).otherwise(x)


def mine_block(candidates: DataFrame, part: pa.Table, positives: int, negatives: int, limits: tuple[int, int]) -> DataFrame:
    """The rows of one block of anchors, written."""
    part = part.combine_chunks()
    block = Anchors(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_pylist())
    found = positives_of(candidates, block, positives).orderBy("anchor", "rank").toArrow()  # at most `positives` for each anchor
    anchor, score, ident = (np.array(found.column(c).to_pylist(), np.int64) for c in ("anchor", "score", "id"))
    spark = candidates.sparkSession
    pairs = {"pair": np.arange(len(anchor)), "anchor_id": block.ids[anchor], "positive_id": ident, "positive_score": score}
    told = negatives_of(candidates, block, np.stack([anchor, score], axis=1), negatives, limits)
    known = spark.createDataFrame(pa.table(pairs))
    joined = told.join(known, "pair").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
    return materialize(joined, "hard-negatives")
