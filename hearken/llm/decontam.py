"""Benchmark decontamination by the CGK embedding.

Texts and benchmark items become sequences of word hashes (lower case; words are runs of letters, digits and non-ASCII
characters). A document contains an item if some stretch of it is within `(1 - SIMILARITY)` of the item's words by edit
distance.

The CGK embedding reads a window with a random walk: at step t it looks at the current word and advances or not by a
random bit of (t, word). Windows a few edits apart are read in step again soon after each edit, so edit distance becomes
Hamming distance between what the walks saw. Bit sampling then takes a few steps of the walk as a key. Documents are read
in windows from every `stride`-th word; of each item all windows are indexed, so a copy at any place lines up with several
of them. Windows have `WINDOWS` words by the size of the item. `REPEATS` walks with `SAMPLES` keys each, over all
windows that a copy holds, reach a recall near one (measured in the tests). Candidates are verified exactly: first a
count of common words, which an item within the distance must pass, then the edit distance itself (bit-parallel).

Documents are never shuffled: each task walks its own windows against the item index. The index is broadcast by the
closure, for at most `max_items` items at once; a larger benchmark is taken in blocks, each over all documents.

Defined results: null or empty texts contain nothing; items of under `MIN_WORDS` words, and null ones, are not searched for.
Rows with a null doc_id give no match row (`clean` keeps them unless their text matches). Repeated rows give one match row
per (doc_id, item_id), that with the smallest distance; ties in distance keep the first place. Very long texts are read
in overlapping pieces. Further columns are ignored here and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.batches import small_batches
from hearken.session import materialize

SIMILARITY = 0.8
MIN_WORDS = 5
WINDOWS = ((15, 12, 4), (8, 6, 2), (MIN_WORDS, 3, 1))  # least words of the item, words of a window, stride
REPEATS = 3
SAMPLES = 5
BITS = 4  # steps in a key
MAX_ITEMS = 20_000
MAX_INDEX_WORDS = 2_000_000  # of all items of a block
PIECE = 1 << 20  # characters of text handled at once
BLOCK = 1 << 14  # windows walked at once
PAIRS = 1 << 11  # regions verified at once
FILTER_BITS = 22
MASK = (1 << 64) - 1
SHIFT = 1 << 39  # an item's first word may lie before the first word read

WORD_BYTE = np.array([chr(c).isalnum() and c < 128 or c >= 128 for c in range(256)])
_rng = np.random.default_rng(20)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
STEPS = {words: 2 * words - words // 3 for _, words, _ in WINDOWS}
WALK = _rng.integers(0, 1 << 31, (REPEATS, max(STEPS.values())), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
PLACES = {
    (words, r, s): frozenset(_rng.choice(steps, min(BITS, steps), replace=False).tolist())
    for words, steps in STEPS.items()
    for r in range(REPEATS)
    for s in range(SAMPLES)
}


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hash, start) of every word of lower-cased UTF-8."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(WORD_BYTE[raw])
    if not len(at):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    new = np.r_[True, np.diff(at) > 1]
    first = np.flatnonzero(new)
    starts = at[first]
    offset = at - np.repeat(starts, np.diff(np.r_[first, len(at)]))
    powers = np.cumprod(np.full(int(offset.max()) + 1, FACTOR | np.uint64(1)), dtype=np.uint64)
    mixed = np.add.reduceat(BYTE_VALUES[raw[at]] * powers[offset], first)
    return ((mixed ^ mixed >> np.uint64(29)) * FACTOR >> np.uint64(32)).astype(np.uint32), starts


def words_of(text: str | None) -> np.ndarray:
    return word_hashes((text or "").lower().encode("utf-8", "replace"))[0]


def walk(words: np.ndarray, starts: np.ndarray, size: int, repeat: int) -> np.ndarray:
    """(SAMPLES, windows) keys of windows that begin at `starts`; `words` ends with enough padding."""
    at = starts.astype(np.int64)
    keys = np.zeros((SAMPLES, len(starts)), np.uint64)
    for step in range(STEPS[size]):
        seen = words[at]
        for sample in range(SAMPLES):
            if step in PLACES[size, repeat, sample]:
                keys[sample] = (keys[sample] ^ seen) * FACTOR
        at += (seen * WALK[repeat, step]) >> np.uint32(31)
    return keys ^ keys >> np.uint64(31)


def distance(item: np.ndarray, masks: dict[int, int], region: np.ndarray) -> int:
    """Least edit distance of the item to any stretch of the region (bit-parallel, one step per word of the region)."""
    size = len(item)
    full, top = (1 << size) - 1, 1 << size - 1
    plus, minus, score = full, 0, size
    least = size
    for word in region.tolist():
        same = masks.get(word, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full  # a stretch may begin anywhere, so no cost comes in from the left
        down = down << 1 & full
        plus = (down | ~((same | minus) | up)) & full
        minus = up & (same | minus)
        least = min(least, score)
    return least


def distances(masks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """`distance` of many items of at most 64 words at once: row t of `masks` has the places of every region's word t."""
    one = np.uint64(1)
    top = one << (sizes - 1).astype(np.uint64)
    full = top | (top - one)
    plus, minus = full.copy(), np.zeros_like(full)
    score = sizes.astype(np.int64)
    least = score.copy()
    for same in masks:
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        score += ((up & top) != 0).astype(np.int64) - ((down & top) != 0)
        up, down = up << one & full, down << one & full
        plus = (down | ~(same | minus | up)) & full
        minus = up & (same | minus)
        np.minimum(least, score, out=least)
    return least


class ItemIndex:
    """Keys of all windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.limits, self.masks, self.ids = [], [], [], []
        self.owners: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        owner: dict[int, list] = {size: [] for _, size, _ in WINDOWS}
        start: dict[int, list] = {size: [] for _, size, _ in WINDOWS}
        chars = 0
        for item_id, text in sorted(items):
            words = words_of(text)
            if len(words) < MIN_WORDS:
                continue
            chars = max(chars, len(text))
            size = next(size for least, size, _ in WINDOWS if len(words) >= least)
            owner[size] += [len(self.items)] * (len(words) - size + 1)
            start[size] += range(len(words) - size + 1)
            masks: dict[int, int] = {}
            for i, word in enumerate(words.tolist()):
                masks[word] = masks.get(word, 0) | 1 << i
            self.ids.append(item_id)
            self.items.append(words)
            self.masks.append(masks)
            self.limits.append(int((1 - SIMILARITY) * len(words) + 1e-9))
        self.overlap = 4 * chars + 1000
        self.sizes = np.array([len(w) for w in self.items], np.int64)
        self.limits = np.array(self.limits, np.int64)
        pairs = sorted((i << 32 | word, mask & MASK) for i, masks in enumerate(self.masks) for word, mask in masks.items())
        self.word_keys = np.array([k for k, _ in pairs], np.uint64)
        self.word_masks = np.array([m for _, m in pairs], np.uint64)
        bitmap = np.zeros(1 << FILTER_BITS, bool)
        bitmap[self.word_keys * FACTOR >> np.uint64(64 - FILTER_BITS)] = True
        self.word_filter = np.packbits(bitmap)
        self.tables = []
        padded = [np.r_[w, np.zeros(2 * WINDOWS[0][1], np.uint32)] for w in self.items]
        base = np.cumsum([0, *map(len, padded)])
        flat = np.concatenate(padded) if padded else np.zeros(0, np.uint32)
        for _, size, stride in WINDOWS:
            if owner[size]:
                owners, starts = np.array(owner[size], np.int32), np.array(start[size], np.int64)
                repeats = []
                for repeat in range(REPEATS):
                    keys = walk(flat, base[owners] + starts, size, repeat)
                    samples = []
                    for row in keys:
                        order = np.argsort(row, kind="stable")
                        bitmap = np.zeros(1 << FILTER_BITS, bool)
                        bitmap[row >> np.uint64(64 - FILTER_BITS)] = True
                        samples.append((row[order], order.astype(np.int32), np.packbits(bitmap)))
                    repeats.append(samples)
                self.tables.append((size, stride, owners, starts, repeats))

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Distinct (item, place where its first word would stand) rows for a sequence of words."""
        padded = np.r_[words, np.zeros(2 * WINDOWS[0][1], np.uint32)]
        found = []
        for size, stride, owners, starts, repeats in self.tables:
            places = np.arange(0, len(words), stride)
            for repeat, samples in enumerate(repeats):
                bitmaps = [np.unpackbits(packed).view(bool) for _, _, packed in samples]
                for at in range(0, len(places), BLOCK):
                    part = places[at : at + BLOCK]
                    for row, (known, order, _), bitmap in zip(walk(padded, part, size, repeat), samples, bitmaps):
                        hit = np.flatnonzero(bitmap[row >> np.uint64(64 - FILTER_BITS)])
                        if len(hit):
                            low, high = np.searchsorted(known, row[hit], "left"), np.searchsorted(known, row[hit], "right")
                            n = high - low
                            which = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
                            shifted = np.repeat(part[hit], n) - starts[which] + SHIFT
                            found.append(owners[which].astype(np.int64) << 40 | shifted)
        packed = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.column_stack([packed >> 40, (packed & (1 << 40) - 1) - SHIFT])

    def regions(self, found: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(item, text, low, high) of the stretches to verify; a copy may begin or end outside its text, so a candidate
        is tried with every text that has enough words near its place."""
        filled = np.flatnonzero(np.diff(bounds) > 0)
        begins = bounds[filled]
        for at in range(0, len(found), BLOCK):
            item, place = found[at : at + BLOCK, 0], found[at : at + BLOCK, 1]
            size, limit = self.sizes[item], self.limits[item]
            first = np.maximum(np.searchsorted(begins, place - limit, "right") - 1, 0)
            n = np.maximum(np.searchsorted(begins, place + size + limit, "left") - first, 0)
            row = np.repeat(np.arange(len(item)), n)
            text = filled[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
            low = np.maximum((place - limit)[row], bounds[text])
            high = np.minimum((place + size + limit)[row], bounds[text + 1])
            kept = high - low >= (size - limit)[row]
            yield item[row[kept]], text[kept], low[kept], high[kept]

    def verified(self, words: np.ndarray, bitmap: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least distance of each item to a stretch of its region, or the item's size where it is beyond the limit."""
        least = self.sizes[item].copy()
        needed = self.sizes[item] - self.limits[item]
        span = np.arange(int((high - low).max(initial=0)))
        where = low[:, None] + span
        inside = where < high[:, None]
        keys = item[:, None].astype(np.uint64) << np.uint64(32) | words[np.minimum(where, len(words) - 1)]
        maybe = bitmap[keys * FACTOR >> np.uint64(64 - FILTER_BITS)] & inside
        rows = np.flatnonzero(maybe.sum(axis=1) >= needed)
        if not len(rows):
            return least
        keys, inside = keys[rows], inside[rows]
        spot = np.minimum(np.searchsorted(self.word_keys, keys), len(self.word_keys) - 1)
        known = (self.word_keys[spot] == keys) & inside
        enough = known.sum(axis=1) >= needed[rows]
        short = np.flatnonzero(enough & (self.sizes[item[rows]] <= 64))
        if len(short):
            masks = np.where(known[short], self.word_masks[spot[short]], np.uint64(0))
            least[rows[short]] = distances(np.ascontiguousarray(masks.T), self.sizes[item[rows[short]]])
        for i in rows[enough & (self.sizes[item[rows]] > 64)].tolist():
            own = int(item[i])
            least[i] = distance(self.items[own], self.masks[own], words[low[i] : high[i]])
        return least

    def matches(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, distance): `bounds` are the first words of the texts and the end of the last one."""
        best: dict[tuple[int, int], int] = {}
        bitmap = np.unpackbits(self.word_filter).view(bool)
        for item, text, low, high in self.regions(self.candidates(words), bounds):
            for at in range(0, len(item), PAIRS):
                part = slice(at, at + PAIRS)
                least = self.verified(words, bitmap, item[part], low[part], high[part])
                near = np.flatnonzero(least <= self.limits[item[part]])
                for t, i, far in zip(text[part][near].tolist(), item[part][near].tolist(), least[near].tolist()):
                    best[t, i] = min(best.get((t, i), far), far)
        for (text, item), far in best.items():
            yield text, item, far

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(text, item, distance) for several texts at once."""
        data = [t.lower().encode("utf-8", "replace") for t in texts]
        words, starts = word_hashes(b"\n".join(data))
        edges = np.cumsum([0, *[len(d) + 1 for d in data]])
        yield from self.matches(words, np.searchsorted(starts, edges))


def pieces(texts: Iterator[str | None], overlap: int) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of (rows, texts) of about PIECE characters; longer texts in overlapping pieces."""
    rows, held, size = [], [], 0
    for row, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(1, len(text) - overlap), PIECE):
            part = text[at : at + PIECE + overlap]
            rows.append(row)
            held.append(part)
            size += len(part)
            if size >= PIECE:
                yield rows, held
                rows, held, size = [], [], 0
    if held:
        yield rows, held


def item_blocks(items: DataFrame, id_col: str, text_col: str, max_items: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size (by items and by words), so that a block's index fits every task."""
    known = items.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text") / 2), F.lit(0)).alias("words")).first()
    blocks = int(max(size["n"] // max_items, size["words"] // MAX_INDEX_WORDS)) + 1
    for block in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).toArrow().to_pylist()
        yield [(r["id"], r["text"]) for r in rows]


def contaminations(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    max_items: int = MAX_ITEMS,
) -> DataFrame:
    """(doc id, item id, distance, item_words, similarity), one row per document and item it contains."""
    plain = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = plain.schema["id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, distance int, item_words int"
    found = None
    for block in item_blocks(items, item_id, item_text, max_items):
        matched = plain.mapInArrow(_searcher(ItemIndex(block)), schema)
        found = matched if found is None else found.unionByName(matched)
    best = found.filter("id is not null").groupBy("id", "item").agg(F.min("distance").alias("distance"), F.first("item_words").alias("item_words"))
    return best.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_id),
        "distance",
        "item_words",
        (1 - F.col("distance") / F.col("item_words")).alias("similarity"),
    )


def _searcher(index: ItemIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in pieces((t.as_py() for t in batch.column(1)), index.overlap):
                hits = [(rows[t], i, far) for t, i, far in index.search(texts)]
                ids = batch.column(0).take(pa.array([r for r, _, _ in hits], pa.int64()))
                numbers = [[index.ids[i] for _, i, _ in hits], [far for _, _, far in hits], [len(index.items[i]) for _, i, _ in hits]]
                kinds = [pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, t) for x, t in zip(numbers, kinds)]], ["id", "item", "distance", "item_words"])

    return run


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that contain no item. Rows without an id are judged by a hash of their text."""
    name = F.coalesce(F.concat(F.lit("id "), F.col(id_col).cast("string")), F.concat(F.lit("text "), F.sha2(text_col, 256)))
    tagged = docs.select(name.alias("name"), F.col(text_col).alias("text"))
    dirty = materialize(contaminations(tagged, items, "name", "text").select("name").distinct(), "contaminated")
    kept = docs.withColumn("_name", name)
    return kept.join(dirty, F.col("_name") == F.col("name"), "left_anti").drop("_name")
