"""SimHash near-duplicates found through Golay-code keys.

A fingerprint has 64 bits in four segments of 16. If two fingerprints differ in at most three bits, then (pigeonhole)
either two segments are equal, or one is equal and each of the three others differs in a single bit. The first case is
met by six keys of two whole segments. For the second, each segment is decoded as a word of the perfect 23-bit Golay
code: every word lies within three bits of exactly one codeword, and any word one bit away has that codeword among the
one or six within four bits of itself. So for each segment taken as equal, a fingerprint is stored under the nearest
codewords of two others and looked up under all near ones, about 28 keys. A link is always met, and candidates are
verified by counting differing bits inside the join. Keys have 32 or 40 bits, so buckets stay small for billions of rows.

Only distinct fingerprints are compared, so groups of copies cost one row. Components come from `components.components`.

Defined results: a null or empty text, or one of white space only, has the fingerprint zero, which links like any
other; a text of one or two words is one shingle. Rows with a null doc_id get a fingerprint and no component. Repeated
rows stay as they are, each with the same fingerprint and component. Further columns are ignored.

`keep_first` asks for more than three bits can tell: texts are near copies if the sets of their five-word shingles have a
Jaccard similarity of at least 0.8 (`similar`). Texts whose fingerprints, here of five-word shingles, are equal or linked
through their Golay keys are candidates. Pairs at 0.8 lie about ten bits apart, so bands of MinHash values add those that
three bits miss: 16 bands of 4 meet a pair at 0.8 with probability 0.9998. Every candidate is verified exactly by its
shingles. Buckets of up to SMALL distinct texts give all pairs; in a larger one all are compared with one leader, which
differs from band to band, so that pairs grow with the rows. A text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.batches import small_batches
from hearken.llm.components import components
from hearken.session import materialize

MAX_BITS = 3
SHINGLE = 3
SEED = 42
SEGMENTS = (0, 16, 32, 48)  # lowest bits
WIDTH = 16
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SLICE = 1 << 16  # shingles whose bits are unpacked at once
NEAR_SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
BAND = 4  # MinHash values in a key
SMALL = 32
MIXED = 1 << 12  # shingles whose MinHash values are computed at once
_rng = np.random.default_rng(11)
FLIPS = _rng.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64)
FACTORS = _rng.integers(0, 1 << 62, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, width: int) -> tuple[int, np.ndarray]:
    """XXH64 of the word sequence and of all its shingles, repeats included; no shingles without a word."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six white-space characters
    joined = b" ".join(words)
    digest, whole = xxhash.xxh64_intdigest, xxhash.xxh64_intdigest(joined, SEED)
    if len(words) <= width:
        return whole, np.array([whole][: len(words)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: 1 - width].tolist(), ends[width - 1 :].tolist()
    return whole, np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        bits = np.unpackbits(hashes[at : at + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None) -> int:
    """Majority of the bits of the XXH64 of all word shingles, as an unsigned number."""
    return majority(shingle_hashes(text, SHINGLE)[1])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 64 bits in a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"id {kind}, fingerprint bigint").withColumnRenamed("id", id_col)


@cache
def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error within three bits, its weight, and the five further errors of four bits (zeros if none)."""
    syndromes = np.zeros(23, np.int64)
    for bit in range(23):
        value = 1 << bit
        for shift in range(bit - 11, -1, -1):
            if value >> (shift + 11) & 1:
                value ^= GENERATOR << shift
        syndromes[bit] = value
    near, weight = np.zeros(2048, np.int64), np.zeros(2048, np.int64)
    far: dict[int, list[int]] = {}
    for size in range(1, 5):
        for bits in combinations(range(23), size):
            error = sum(1 << b for b in bits)
            syndrome = int(np.bitwise_xor.reduce(syndromes[list(bits)]))
            if size < 4:
                near[syndrome], weight[syndrome] = error, size
            elif weight[syndrome] == 3:
                far.setdefault(syndrome, []).append(error)
    table = np.zeros((2048, 5), np.int64)
    for syndrome, errors in far.items():
        table[syndrome] = errors
    by_byte = np.zeros((3, 256), np.int64)
    for part in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and part * 8 + bit < 23:
                    by_byte[part, value] ^= syndromes[part * 8 + bit]
    return by_byte, np.column_stack([near, weight]), table


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within four bits: an (n, 6) array, and how many of its columns count (1 or 6).

    The first column is the nearest codeword.
    """
    by_byte, near, far = code_tables()
    syndrome = by_byte[0, words & 255] ^ by_byte[1, words >> 8 & 255] ^ by_byte[2, words >> 16 & 255]
    errors = np.column_stack([near[syndrome, 0], far[syndrome]])
    return (words[:, None] ^ errors) >> 11, np.where(near[syndrome, 1] == 3, 6, 1)


def keys(prints: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key): ten keys to store it under, or with `probe` all keys to look it up by."""
    values = prints.view(np.uint64)
    parts = [(values >> np.uint64(low) & np.uint64((1 << WIDTH) - 1)).astype(np.int64) for low in SEGMENTS]
    words = [codeword_indices(p) for p in parts]
    everyone = np.arange(len(values))
    rows, found, kind = [], [], 0
    for a, b in combinations(range(4), 2):
        rows.append(everyone)
        found.append(kind << 40 | parts[a] << 16 | parts[b])
        kind += 1
    for same in range(4):
        (left, n_left), (right, n_right) = words[(same + 1) % 4], words[(same + 2) % 4]
        for i in range(6 if probe else 1):
            for j in range(6 if probe else 1):
                at = np.flatnonzero((n_left > i) & (n_right > j))
                rows.append(at)
                found.append(kind << 40 | parts[same][at] << 24 | left[at, i] << 12 | right[at, j])
        kind += 1
    return np.concatenate(rows), np.concatenate(found)


def with_keys(prints: DataFrame, probe: bool) -> DataFrame:
    """(key, fingerprint) rows of a table of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            rows, found = keys(values, probe)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(values[rows])], ["key", "fingerprint"])

    return prints.select("fingerprint").mapInArrow(run, "key bigint, fingerprint bigint")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) with a < b: all pairs of distinct fingerprints that differ in at most MAX_BITS bits."""
    probes = with_keys(distinct, True).withColumnRenamed("fingerprint", "a")
    stored = with_keys(distinct, False).withColumnRenamed("fingerprint", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    met = probes.alias("p").join(
        stored.alias("s").hint("shuffle_hash"), (F.col("p.key") == F.col("s.key")) & (F.col("a") != F.col("b")) & near
    )
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): component_id is the smallest id reachable over links of fingerprints."""
    prints = materialize(with_fingerprints(docs, id_col, text_col), "simhash")
    distinct = materialize(
        prints.filter(F.col(id_col).isNotNull()).groupBy("fingerprint").agg(F.min(id_col).alias("first")), "fingerprints"
    )
    merged = components(links(distinct), distinct.select(F.col("fingerprint").alias("id"), "first"))
    named = merged.select(F.col("id").alias("fingerprint"), F.col("first").alias("component_id"))
    wide = prints.join(named, "fingerprint", "left")
    own = F.when(F.col(id_col).isNotNull(), F.col("component_id"))
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return wide.select(id_col, hexed.alias("fingerprint"), own.alias("component_id"))


def distinct_shingles(whole: int, hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes; a text without words has the hash of its empty sequence."""
    return np.unique(hashes) if len(hashes) else np.array([whole], np.uint64)


def shingle_set(text: str | None, width: int) -> tuple[int, np.ndarray]:
    """Hash of the word sequence, and the distinct hashes of its shingles."""
    whole, hashes = shingle_hashes(text, width)
    return whole, distinct_shingles(whole, hashes)


def band_keys(shingles: np.ndarray) -> list[int]:
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), MIXED):
        mixed = (shingles[at : at + MIXED] ^ FLIPS[:, None]) * FACTORS[:, None]
        least = np.minimum(least, mixed.min(axis=1))
    return [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, BAND))]


def _banded(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, print, fingerprint, size of the shingle set, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shingle_hashes(t.as_py(), width) for t in batch.column(1)]
            sets = [distinct_shingles(*r) for r in rows]
            prints = pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64))
            marks = pa.array(np.array([majority(r[1]) for r in rows], np.uint64).view(np.int64))
            keys = pa.array(list(np.array([band_keys(s) for s in sets], np.uint64).reshape(-1, BANDS).view(np.int64)), pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, marks, sizes, keys], ["id", "print", "fingerprint", "size", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"id {kind}, print bigint, fingerprint bigint, size int, keys array<bigint>")


def _shingled(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(print, shingles), one row per print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            prints = pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64))
            sets = pa.array([r[1].view(np.int64) for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([prints, sets], ["print", "shingles"])

    picked = small_batches(docs).select(F.col(text_col).cast("string"))
    return picked.mapInArrow(run, "print bigint, shingles array<bigint>").dropDuplicates(["print"])


def simhash_keys(distinct: DataFrame) -> DataFrame:
    """(print, size, key): a key for every fingerprint, and one for every two that `links` finds through their Golay keys."""
    marks = materialize(distinct.select("fingerprint").distinct(), "fingerprints")
    pairs = links(marks).unionByName(marks.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")))
    sides = F.explode(F.array_distinct(F.array("a", "b"))).alias("fingerprint")
    return distinct.join(pairs.select(sides, F.xxhash64("a", "b").alias("key")), "fingerprint").select("print", "size", "key")


def candidates(distinct: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(lead, other): distinct pairs of prints that share a bucket and whose sizes allow the similarity.

    Prints share a bucket if their fingerprints are equal or linked, and if they share a MinHash band.
    """
    rows = simhash_keys(distinct).unionByName(distinct.select("print", "size", F.explode("keys").alias("key")))
    order = F.struct(F.xxhash64("print", "key").alias("turn"), F.col("print").alias("lead"), F.col("size").alias("lead_size"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    shared = materialize(rows.join(buckets.select("key", "n", "first.lead", "first.lead_size"), "key"), "buckets")
    large = shared.filter(F.col("n") > SMALL).select("lead", "lead_size", F.col("print").alias("other"), "size")
    small = shared.filter(F.col("n") <= SMALL).select("key", "print", "size")
    pairs = small.select("key", F.col("print").alias("lead"), F.col("size").alias("lead_size")).join(small.withColumnRenamed("print", "other"), "key")
    pairs = pairs.filter("lead < other").select("lead", "lead_size", "other", "size")
    fits = F.least("lead_size", "size") >= similarity * F.greatest("lead_size", "size")
    return pairs.unionByName(large.filter("lead <> other")).filter(fits).select("lead", "other").distinct()


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """(id, component_id) of rows with an id: the smallest id reachable over pairs of at least that Jaccard similarity."""
    named = docs.filter(F.col(id_col).isNotNull())
    prints = materialize(_banded(named, id_col, text_col, shingle), "shingles")
    least = F.min(F.struct("id", "fingerprint", "size", "keys")).alias("row")
    alone = prints.groupBy("print").agg(least).select("print", F.col("row.id").alias("first"), "row.fingerprint", "row.size", "row.keys")
    distinct = materialize(alone, "prints")
    pairs = materialize(candidates(distinct, similarity), "pairs")
    asked = pairs.select(F.col("lead").alias("print")).unionByName(pairs.select(F.col("other").alias("print"))).distinct()
    ids = distinct.join(asked, "print", "left_semi").select(F.col("first").alias(id_col)).distinct()
    sets = materialize(_shingled(named.join(ids, id_col, "left_semi"), text_col, shingle), "sets")
    met = pairs.join(sets.select(F.col("print").alias("other"), F.col("shingles").alias("b")), "other")
    met = met.join(sets.select(F.col("print").alias("lead"), F.col("shingles").alias("a")), "lead")
    common = F.size(F.array_intersect("a", "b"))
    linked = met.filter(common >= similarity * (F.size("a") + F.size("b") - common)).select(F.col("lead").alias("a"), F.col("other").alias("b"))
    merged = components(linked, distinct.select(F.col("print").alias("id"), "first"))
    owners = merged.select(F.col("id").alias("print"), F.col("first").alias("component_id"))
    return prints.select(F.col("id").alias(id_col), "print").join(owners, "print").select(id_col, "component_id")


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """The documents with one row per component of `similar`, the smallest id; rows with a null id stay.

    Of repeated rows with that id one stays, the one with the smallest text.
    """
    first = similar(docs, id_col, text_col, shingle, similarity).filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    kept = docs.join(first, id_col, "left_semi")
    rest = [c for c in docs.columns if c != id_col]
    once = kept.groupBy(id_col).agg(F.min(F.struct(text_col, *[c for c in rest if c != text_col])).alias("row"))
    once = once.select(id_col, *[F.col("row")[c].alias(c) for c in rest]).select(docs.columns)
    return once.unionByName(docs.filter(F.col(id_col).isNull()))
