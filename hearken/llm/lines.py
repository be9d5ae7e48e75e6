"""Line deduplication with two Bloom filters.

Keys are lines with the white space of both ends removed and A-Z lower-cased. A key of at least `min_chars` code points
that stands in two or more documents stays only in the smallest doc_id that holds it.

1. Every task hashes the keys of its documents (64 bits, once per document), keeps at most two of each hash and deals
   them, packed into arrays, by their top bits to shards; neither text nor a row per line is shuffled. The number of
   shards follows from the characters of all texts, so a shard has a bounded number of hashes at any corpus size.
2. Each shard puts its hashes into its once-seen filter, `BITS_PER_KEY` bits for each; hashes that it holds already have
   been seen twice. These go, each once, into the twice-seen filter, which is sized by their counted number.
3. The documents are read again, and only lines whose hash is in the twice-seen filter go on, with their text. The
   filter is broadcast if it has at most `broadcast_bytes` (known from the count before it is built); beyond that the
   hashes of the documents meet the hashes seen twice in a shuffled semi-join.
4. Exact confirmation: suspected lines are grouped by their whole text, and lines of later documents are dropped.

A Bloom filter has no false negatives, so a repeated key is always suspected; false suspects are cleared by step 4.

Defined results: a null or empty text is one empty line and stays as it is. Rows with a null doc_id are left alone and
hold nothing. Rows that share a doc_id count as one document, so repeated rows do not drop each other's lines. A line
repeated within the first document stays there each time. Other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.batches import small_batches
from hearken.session import materialize

SPACES = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
BITS_PER_KEY = 12
PROBES = 3
SHARD_KEYS = 1 << 22  # hashes a shard sees on average
TWICE_KEYS = 1 << 22  # hashes in one part of the twice-seen filter
BROADCAST_BYTES = 64 << 20  # of the twice-seen filter
SLAB = 4 << 20  # bytes of text handled at once


def line_table(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row of the text, key, line number within its text) of the lines whose keys are long enough."""
    split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    rows = pc.list_parent_indices(split).to_numpy()
    starts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
    keys = pc.ascii_lower(pc.ascii_trim(pc.list_flatten(split), SPACES))
    long = pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(long)
    return rows[at], keys.take(pa.array(at)), at - starts[rows[at]]


def hashes(keys: pa.Array) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, keys.cast(pa.large_binary()).to_pylist()), np.uint64, len(keys))


def slabs(batch: pa.RecordBatch, column: int, size: int = SLAB) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `size` bytes of text, so that one batch of long texts does not fill the memory."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def packed_hashes(docs: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """(shard, hashes): the distinct key hashes of every document, packed per slab and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch, 1):
                rows, keys, _ = line_table(part.column(1), min_chars)
                if not len(rows):
                    continue
                ids = pa.array(part.column(0)).dictionary_encode().indices.to_numpy()[rows]
                found = hashes(keys)
                order = np.lexsort((ids, found))
                found, ids = found[order], ids[order]
                other = np.r_[True, (found[1:] != found[:-1]) | (ids[1:] != ids[:-1])]
                found = found[other]  # once per document
                found = found[np.r_[True, True, found[2:] != found[:-2]][: len(found)]]  # twice at most
                home = home_of(found, shards)
                cuts = np.flatnonzero(np.diff(home)) + 1
                names = home[np.r_[0, cuts]]
                data = [x.astype("<u8").tobytes() for x in np.split(found, cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(data, pa.binary())], ["shard", "hashes"])

    return docs.mapInArrow(run, "shard bigint, hashes binary")


class Bloom:
    """A Bloom filter over 64-bit hashes, vectorised."""

    def __init__(self, keys: int):
        self.bits = np.zeros(keys * BITS_PER_KEY // 8 + 1, np.uint8)

    @classmethod
    def of(cls, bits: bytes) -> Bloom:
        own = cls(0)
        own.bits = np.frombuffer(bits, np.uint8)
        return own

    def places(self, found: np.ndarray) -> np.ndarray:
        low, high = found & np.uint64(0xFFFFFFFF), found >> np.uint64(32)
        mixed = (low * np.uint64(0x9E3779B97F4A7C15) ^ high) | np.uint64(1)
        return np.stack([(found + np.uint64(i) * mixed) % np.uint64(len(self.bits) * 8) for i in range(PROBES)]).astype(np.int64)

    def add(self, places: np.ndarray) -> None:
        np.bitwise_or.at(self.bits, places >> 3, (1 << (places & 7)).astype(np.uint8))

    def holds(self, places: np.ndarray) -> np.ndarray:
        return (self.bits[places >> 3] >> (places & 7) & 1).all(axis=0)


def home_of(found: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the hashes."""
    return (found >> np.uint64(40)).astype(np.int64) * shards >> 24


def seen_twice(once: Bloom, found: np.ndarray) -> np.ndarray:
    """Adds hashes to a once-seen filter; returns those that it held before or that come twice here."""
    values, counts = np.unique(found, return_counts=True)
    places = once.places(values)
    again = once.holds(places) | (counts > 1)
    once.add(places)
    return values[again]


def suspects(docs: DataFrame, min_chars: int) -> DataFrame:
    """(hash): the 64-bit hashes, as longs, of keys that two documents seem to share."""
    most = docs.agg(F.sum(F.length(docs.columns[1]))).first()[0] or 0
    most = most // (min_chars + 1) + 1  # keys that so many characters can hold
    shards = most // SHARD_KEYS + 1
    per_shard = most * 5 // 4 // shards + 1024

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, Bloom] = {}
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard not in once:
                    once[shard] = Bloom(per_shard)
                again = seen_twice(once[shard], np.frombuffer(data.as_buffer(), "<u8"))
                yield pa.RecordBatch.from_arrays([pa.array(again.view(np.int64))], ["hash"])

    packed = packed_hashes(docs, shards, min_chars)
    return packed.repartition(shards, "shard").mapInArrow(run, "hash bigint").distinct()


class Twice:
    """The parts of the twice-seen filter, each for a range of hashes."""

    def __init__(self, bits: dict[int, bytes], parts: int):
        self.parts, self.filters = parts, {k: Bloom.of(v) for k, v in bits.items()}

    def holds(self, found: np.ndarray) -> np.ndarray:
        held, home = np.zeros(len(found), bool), home_of(found, self.parts)
        for part, own in self.filters.items():
            at = np.flatnonzero(home == part)
            held[at] = own.holds(own.places(found[at]))
        return held


def twice_filter(found: DataFrame, count: int) -> Twice:
    """Built in one task for each part; the parts have count * BITS_PER_KEY bits together."""
    parts = count // TWICE_KEYS + 1
    size = count * 5 // 4 // parts + 1024

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, Bloom] = {}
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            home = home_of(values, parts)
            for part in np.unique(home).tolist():
                own = filters.setdefault(part, Bloom(size))
                own.add(own.places(values[home == part]))
        data = [pa.array(list(filters), pa.int64()), pa.array([x.bits.tobytes() for x in filters.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(data, ["part", "bits"])

    part = F.shiftright(F.shiftrightunsigned("hash", 40) * parts, 24)
    built = found.repartition(parts, part).mapInArrow(run, "part bigint, bits binary").toArrow()
    return Twice(dict(zip(built.column(0).to_pylist(), built.column(1).to_pylist())), parts)


def marked_lines(docs: DataFrame, min_chars: int, broadcast_bytes: int) -> DataFrame:
    """(id, tag, line, key) of the lines of `docs` (id, text, tag) whose hash seems to be seen twice."""
    found = materialize(suspects(docs, min_chars), "suspects")
    count = found.count()
    if count * BITS_PER_KEY // 6 <= broadcast_bytes:
        shared = docs.sparkSession.sparkContext.broadcast(twice_filter(found, count))
        return _lines(docs, min_chars, shared).drop("hash")
    return _lines(docs, min_chars, None).join(found, "hash", "left_semi").drop("hash")


def _lines(docs: DataFrame, min_chars: int, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch, 1):
                rows, keys, line = line_table(part.column(1), min_chars)
                found = hashes(keys)
                if shared is not None:
                    hit = np.flatnonzero(shared.value.holds(found))
                    rows, keys, line, found = rows[hit], keys.take(pa.array(hit)), line[hit], found[hit]
                at = pa.array(rows)
                columns = [part.column(0).take(at), part.column(2).take(at), pa.array(line.astype(np.int32)), keys.cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], ["id", "tag", "line", "key", "hash"])

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, tag bigint, line int, key string, hash bigint")


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """`docs` with the repeated lines dropped from the text, and the columns n_lines and n_dropped."""
    tag = F.xxhash64(text_col)
    plain = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), tag.alias("tag"))
    marked = materialize(marked_lines(plain.filter("id is not null"), min_chars, broadcast_bytes), "lines")
    firsts = marked.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    firsts = materialize(firsts.select("key", "first"), "firsts")  # a plain side lets Spark split a hot key of the other
    later = marked.join(firsts, "key").filter("id > first")
    drops = later.groupBy("id", "tag").agg(F.collect_set("line").alias("drops"))

    names = {"id": "_dedup_id", "tag": "_dedup_tag", "drops": "_dedup_lines"}
    drops = drops.select(*[F.col(c).alias(x) for c, x in names.items()]).hint("shuffle_hash")
    joined = docs.join(drops, (docs[id_col] == F.col("_dedup_id")) & (tag == F.col("_dedup_tag")), "left")
    lines = F.split(F.coalesce(text_col, F.lit("")), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_dedup_lines"))
    text = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    text = F.when(F.col("_dedup_lines").isNull(), F.col(text_col)).otherwise(text)
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_dedup_lines"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
