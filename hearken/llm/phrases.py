"""Collocations of words by prefix-free parsing.

The words of a text, with a mark wherever a piece ends, are parsed into chunks: a chunk starts at the first word of a text and
wherever a hash of the next `size` tokens is divisible by `modulus`, where `size` is one less than the longest phrase. It
runs to the start of the next chunk and `size` tokens on, so neighbours overlap by just that trigger. Cuts depend only on
the words around them, so equal passages give equal chunks wherever they stand, and the distinct chunks form a dictionary with
parse frequencies. Phrases are counted inside each distinct chunk, once for its frequency: those that begin before the
overlap, which belongs to the next chunk. So every occurrence in the corpus is counted once, and copies cost one chunk.

Phrases of up to two words are counted first. A longer phrase can be frequent only if both phrases that are one word shorter
are, so longer ones are given out by the tasks only if a Bloom filter holds both; it has `FILTER_KEYS` keys at most, whatever
the corpus, and no false negatives: beyond that it passes more, and the counts decide. Everything is summed by partial
aggregation and compared exactly; scores are divisions of whole decimal numbers of up to 38 digits, which overflow (with
an error) only beyond 10**16 occurrences of one phrase.

Defined results: a null or empty text has no words and counts nowhere; a null language is `und`, joined with texts that are so
marked. Rows are counted as they stand, repeated ones too; doc_id plays no part. Equal scores go to the smaller number of
first words, equal ranks to the higher count, then to the phrase in byte order. Further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearken.llm.batches import small_batches
from hearken.llm.lines import slabs, twice_filter
from hearken.session import materialize

MOST_WORDS = 3
LEAST = 10  # occurrences of a candidate
SHARE = 50  # per cent of a phrase's occurrences inside one longer candidate that make it a part of that
TOP = 2000
MODULUS = 32  # tokens in a chunk on average
FILTER_KEYS = 1 << 25  # 63 MB of filter
SLAB = 8 << 20  # bytes of chunks counted at once

SPACE, END = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = SPACE
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = END
MARK = "\n"


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(tokens, whether a mark, first token of every text): words in lower case and one mark after every piece."""
    lower = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    closed = pc.binary_join_element_wise(lower, pa.scalar("", pa.large_string()), pa.scalar(MARK, pa.large_string()))
    ends = np.frombuffer(closed.buffers()[1], np.int64)[: len(closed) + 1]
    data = np.frombuffer(closed.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy()
    ends = ends - ends[0]
    kind = KIND[data]
    data[kind == END] = ord(MARK)
    word = kind == 0
    starts = word & np.r_[True, ~word[:-1]]
    at = np.flatnonzero(starts | (kind == END))
    mark = kind[at] == END
    first = np.searchsorted(at, ends[:-1])
    opens = np.zeros(len(at), bool)
    opens[first] = True
    keep = ~(mark & np.r_[True, mark[:-1]]) | (mark & opens)  # of marks in a row the first stays
    used = word.copy()
    used[at[mark & keep]] = True
    at, mark = at[keep], mark[keep]
    first = np.searchsorted(at, ends[:-1])
    offsets = np.cumsum(np.r_[0, used])[np.r_[at, len(data)]].astype(np.int64)
    flat = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[used].tobytes()))
    return flat, mark, first


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def digests(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = words.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def parse(docs: DataFrame, most_words: int, modulus: int) -> DataFrame:
    """(lang, own, chunk): the chunks of rows (lang, text); phrases of the first `own` tokens belong to the chunk."""
    size = most_words - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch, 1):
                words, _, first = tokens(part.column(1))
                codes, names = coded(words)
                own = mixed(digests(names))[codes]
                rolled = own.copy()
                for i in range(1, size):
                    rolled[:-i] = mixed(rolled[:-i] + own[i:])
                starts = rolled % np.uint64(modulus) == 0
                starts[first] = True
                starts = np.flatnonzero(starts)
                last = np.r_[first[1:], len(words)]
                text = np.searchsorted(first, starts, "right") - 1
                nexts = np.minimum(np.r_[starts[1:], len(words)], last[text])
                stops = np.minimum(nexts + size, last[text])
                sizes = stops - starts
                offsets = np.r_[0, np.cumsum(sizes)]
                taken = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
                lists = pa.LargeListArray.from_arrays(pa.array(offsets), words.take(pa.array(taken)))
                chunk = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
                columns = [part.column(0).take(pa.array(text)), pa.array((nexts - starts).astype(np.int32)), chunk.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "own", "chunk"])

    return docs.mapInArrow(run, "lang string, own int, chunk string")


class Grams:
    """The phrases of a slab of chunks by number of words, as numbers of distinct phrases."""

    def __init__(self, langs: pa.Array, own: np.ndarray, chunks: pa.Array):
        split = pc.split_pattern(chunks.cast(pa.large_string()), " ")
        counts = split.value_lengths().to_numpy()
        self.codes, self.names = coded(split.flatten())
        self.mark = pc.equal(self.names, MARK).to_numpy(zero_copy_only=False)[self.codes]
        self.chunk = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(self.codes)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.counted = place < own[self.chunk]
        lang, self.langs = coded(langs)
        self.seed, self.own = mixed(digests(self.langs)), mixed(digests(self.names))
        self.at = np.flatnonzero(~self.mark)  # where the phrases of this size begin
        self.key = lang[self.chunk[self.at]] * len(self.names) + self.codes[self.at]
        self.words = 1
        self.number()

    def number(self) -> None:
        """Distinct phrases get numbers; `lead` and `tail` tell how they are made."""
        values, self.ids = np.unique(self.key, return_inverse=True)
        lead, tail = values // len(self.names), values % len(self.names)
        if self.words == 1:
            self.lang, self.text, self.hash = lead, self.names.take(pa.array(tail)), self.own[tail] ^ self.seed[lead]
        else:
            self.lang = self.lang[lead]
            self.text = pc.binary_join_element_wise(self.text.take(pa.array(lead)), self.names.take(pa.array(tail)), pa.scalar(" ", pa.large_string()))
            self.hash = mixed(self.hash[lead] + self.own[tail])

    def longer(self, holds=None) -> None:
        """On to phrases of one more word; with `holds`, only those whose two parts are held."""
        known = np.full(len(self.codes) + self.words, -1)
        known[self.at] = self.ids
        end = self.at + self.words
        fits = end < len(self.codes)
        end = np.minimum(end, len(self.codes) - 1)
        fits &= (self.chunk[end] == self.chunk[self.at]) & ~self.mark[end]
        if holds is not None and len(self.hash):
            good = np.r_[holds(self.hash), [False]]
            fits &= good[self.ids] & good[known[self.at + 1]]
        lead = self.ids[fits]
        self.key = lead * len(self.names) + self.codes[end[fits]]
        self.at = self.at[fits]
        self.words += 1
        self.number()

    def sums(self, freq: np.ndarray) -> pa.RecordBatch:
        mine = self.counted[self.at]
        total = np.bincount(self.ids[mine], freq[self.chunk[self.at[mine]]], len(self.text)).astype(np.int64)  # exact below 2**53
        some = np.flatnonzero(total)
        columns = [
            self.langs.take(pa.array(self.lang[some])).cast(pa.string()),
            pa.array(np.full(len(some), self.words, np.int32)),
            self.text.take(pa.array(some)).cast(pa.string()),
            pa.array(total[some]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "f"])


def totals(sums: pa.RecordBatch) -> pa.RecordBatch:
    """All words of each language, as the phrase of no words."""
    found = pa.table([sums.column(0), sums.column(3)], ["lang", "f"]).group_by("lang").aggregate([("f", "sum")]).combine_chunks()
    n = found.num_rows
    columns = [found.column("lang"), pa.array(np.zeros(n, np.int32)), pa.array([""] * n, pa.string()), found.column("f_sum")]
    return pa.table(columns, ["lang", "words", "phrase", "f"]).combine_chunks().to_batches()[0] if n else sums.slice(0, 0)


def counted(chunks: DataFrame, sizes: list[int], held=None) -> DataFrame:
    """(lang, words, phrase, f) of all phrases of the given sizes in weighted chunks (lang, chunk, own, freq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch, 1, SLAB):
                freq = part.column(3).to_numpy()
                grams = Grams(part.column(0), part.column(2).to_numpy(), part.column(1))
                while True:
                    if grams.words in sizes:
                        sums = grams.sums(freq)
                        yield sums
                        if grams.words == 1:
                            yield totals(sums)
                    if grams.words == max(sizes):
                        break
                    last = held is not None and grams.words + 1 == max(sizes)
                    grams.longer(held.value.holds if last else None)

    found = chunks.mapInArrow(run, "lang string, words int, phrase string, f bigint")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def hashed(phrases: DataFrame) -> DataFrame:
    """(hash): the phrases' hashes, as `Grams` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, langs = coded(batch.column(0))
            split = pc.split_pattern(batch.column(1), " ")
            codes, names = coded(split.flatten())
            sizes = split.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            own = mixed(digests(names))
            total = own[codes[starts]] ^ mixed(digests(langs))[lang]
            for i in range(1, int(sizes.max())):
                total = np.where(i < sizes, mixed(total + own[codes[np.minimum(starts + i, len(codes) - 1)]]), total)
            yield pa.RecordBatch.from_arrays([pa.array(total.view(np.int64))], ["hash"])

    return phrases.select("lang", "phrase").mapInArrow(run, "hash bigint")


def frequencies(docs: DataFrame, least: int, most_words: int, modulus: int) -> DataFrame:
    """(lang, words, phrase, f) of all phrases of f >= least; the phrase of no words has the words of its language."""
    parsed = parse(docs, most_words, modulus).groupBy("lang", "own", "chunk").agg(F.count("*").alias("freq"))
    chunks = materialize(parsed.select("lang", "chunk", "own", "freq"), "chunks")
    enough = (F.col("f") >= least) | (F.col("words") == 0)
    found = materialize(counted(chunks, [1, 2][:most_words]).filter(enough), "phrases")
    for size in range(3, most_words + 1):
        parts = found.filter(F.col("words") == size - 1)
        held = twice_filter(hashed(parts), min(parts.count(), FILTER_KEYS))
        shared = docs.sparkSession.sparkContext.broadcast(held)
        found = found.unionByName(materialize(counted(chunks, [size], shared).filter(enough), "phrases"))
    return found


def parts_of(first: str, size: str) -> str:
    return f"array_join(slice(ws, {first}, {size}), ' ')"


def mine(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = LEAST,
    most_words: int = MOST_WORDS,
    share: int = SHARE,
    top: int = TOP,
    modulus: int = MODULUS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to `most_words` words that hold together best."""
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    found = frequencies(small_batches(given), least, most_words, modulus)
    known = found.filter("words > 0").select("lang", "phrase", "f")
    candidates = found.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))

    spans = F.expr("""flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(ws, i, m), ' '))))""")
    inner = candidates.filter("words > 2").select("lang", F.explode(spans).alias("phrase"), "a")
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_covered"))

    cut = candidates.select("lang", "phrase", "a", "words", "ws", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cut = cut.selectExpr("lang", "phrase", "a", "k", f"{parts_of('1', 'k')} first", f"{parts_of('k + 1', 'words - k')} rest")
    cut = cut.join(known.selectExpr("lang", "phrase first", "f l"), ["lang", "first"]).join(known.selectExpr("lang", "phrase rest", "f r"), ["lang", "rest"])
    score = F.expr("""(cast(1000000 as decimal(7, 0)) * cast(a as decimal(16, 0)) * cast(a as decimal(16, 0)))
        div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))""")
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low"))
    kept = lowest.join(covered, ["lang", "phrase"], "left").filter(f"_covered is null or 100 * _covered < {share} * a")
    ranked = kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    )
    sums = found.filter("words = 0").select("lang", F.col("f").alias("n"))  # one row for each language
    return ranked.filter(F.col("rank") <= top).join(sums, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
