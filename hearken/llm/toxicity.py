"""Toxicity by a weighted finite-state grammar of clauses.

Words become symbols: graded insults, threats, targets (who is spoken to or of), negations, words of reported speech, and
others. Three small transducers read the symbols of a clause one after another and are composed into one:

* `reported`: after a word of speech, insults and threats are handed on as reported ones to the end of the clause;
* `negated`: within `REACH` words after a negation, they are handed on as negated ones;
* `scored`: an insult weighs its grade; next to a target (within `REACH` words on either side) one more; a threat weighs
  only if a target follows within `REACH` words; negated and reported ones weigh less, and never below zero.

The composed machine is a table of states and symbols. Only clauses (between marks or line ends) that hold an insult or a
threat are run through it, over the words that are not "other"; runs of other words only let the reach pass. The weight
of a text is that of its clauses, so a word alone says less than the clause it stands in.

Insults are learned: of the training texts every word and its beginnings of `STEMS` letters are counted, once a text, among toxic
and clean ones (in Spark, by partial aggregation). Those whose log-likelihood ratio is at least `LEAST_RATIO`, towards
toxic, are the lexicon (the `LEXICON` strongest, a size of the model), and the lower bound of the log odds is the grade.
Threats, targets, negations and words of speech are fixed lists. Three numbers drawn from a text (its weight, damped and
plain, and its heaviest clause) and a constant then make the score in a logistic model with a ridge penalty.

Training takes about `DOCS_PER_CLASS` labelled documents of each class (all, if there are fewer), by a hash of doc_id; the shares of the
classes are those of all labels. The chosen ids are bounded by that and are broadcast, so no text is shuffled.

Defined results: a null or empty text has no clause and the score of any text without a match. Null ids are never training
rows (held_out is false for them). Labels that are null or without a document teach nothing; repeated rows count as often
as they stand there. With labels of one class only the score is that class for every text, without labels 0.5. Further
columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hearken.llm.batches import small_batches
from hearken.llm.lines import slabs

DOCS_PER_CLASS = 20000
LEXICON = 4096
LEAST_RATIO = 13.0
STEMS = (4, 5, 6)
GRADES = 8
REACH = 3
NEGATED, REPORTED, TARGETED, THREAT = -6, -4, 1, 5
MOST = 30  # of the total weight that counts in full
RIDGE = 0.05
FEATURES = ("damped", "total", "most")

# Fixed lists, in English, German, French and Spanish.
THREATS = "kill hurt beat destroy murder stab shoot strangle töte töten erschlage erschieße tuer tuerai frapper matar mataré golpear".split()
TARGETS = "you your he she they him her them u ya du dich dir euch ihr sie tu te toi vous ton ta usted ustedes ti él ella".split()
NEGATIONS = "not never no none nobody isn aren wasn don doesn didn won nicht kein keine keinen nie ne pas jamais aucun nunca ningún ninguna jamás".split()
SPEECH = "said says told called calls wrote writes quoted reported sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió".split()

OTHER, INSULT, THREATEN, TARGET, NEGATION, SAY = 0, 1, GRADES + 1, GRADES + 2, GRADES + 3, GRADES + 4
SYMBOLS = GRADES + 5
PLAIN, REPORT, NEGATE = 0, 1, 2  # how an insult or a threat is handed on: symbol + way * SYMBOLS


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (symbol handed on, weight, next state); one arc for each, state 0 first."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, int, int]]

    def after(self, other: Transducer) -> Transducer:
        """The machine that hands what `other` gives to this one; states are pairs."""
        arcs = {}
        for (s, symbol), (given, weight, to) in other.arcs.items():
            for t in range(self.states):
                if (t, given) in self.arcs:
                    out, more, then = self.arcs[t, given]
                    arcs[s * self.states + t, symbol] = (out, weight + more, to * self.states + then)
        return Transducer(other.states * self.states, arcs)


def loaded(symbol: int) -> bool:
    """An insult or a threat."""
    return INSULT <= symbol <= THREATEN


def reported() -> Transducer:
    arcs = {}
    for state in (0, 1):
        for symbol in range(SYMBOLS):
            arcs[state, symbol] = (symbol + REPORT * SYMBOLS * (state == 1 and loaded(symbol)), 0, int(state == 1 or symbol == SAY))
    return Transducer(2, arcs)


def negated() -> Transducer:
    """The state is the number of words that a negation still reaches."""
    arcs = {}
    for state in range(REACH + 1):
        for symbol in range(2 * SYMBOLS):
            way, bare = divmod(symbol, SYMBOLS)
            turned = state > 0 and loaded(bare) and way == PLAIN
            arcs[state, symbol] = (symbol + NEGATE * SYMBOLS * turned, 0, REACH if bare == NEGATION else max(0, state - 1))
    return Transducer(REACH + 1, arcs)


def scored() -> Transducer:
    """States: 0, then words left after a target, then words left in which a target completes an insult, then a threat."""
    near, insult, threat = (1 + REACH * i for i in range(3))
    arcs = {}
    for state in range(1 + 3 * REACH):
        kind, left = (0, 0) if state == 0 else ((state - 1) // REACH + 1, REACH - (state - 1) % REACH)
        on = state + 1 if left > 1 else 0
        for symbol in range(3 * SYMBOLS):
            way, bare = divmod(symbol, SYMBOLS)
            less = {PLAIN: 0, REPORT: REPORTED, NEGATE: NEGATED}[way]
            weight, to = 0, on
            if INSULT <= bare < THREATEN:
                weight = max(0, bare - INSULT + 1 + less + TARGETED * (kind == 1))
                to = near if kind == 1 else insult
            elif bare == THREATEN:
                to = threat if way == PLAIN else on
            elif bare == TARGET:
                weight, to = {2: TARGETED, 3: THREAT}.get(kind, 0), near
            arcs[state, symbol] = (0, weight, to)
    return Transducer(1 + 3 * REACH, arcs)


@dataclass
class Machine:
    """The composed transducers as tables; `quiet[n]` is the state after n other words."""

    to: np.ndarray
    weight: np.ndarray
    rests: int = REACH + 1

    @classmethod
    def build(cls) -> Machine:
        whole = scored().after(negated()).after(reported())
        to, weight = np.zeros((whole.states, SYMBOLS), np.int64), np.zeros((whole.states, SYMBOLS), np.int64)
        for (state, symbol), (_, w, then) in whole.arcs.items():
            to[state, symbol], weight[state, symbol] = then, w
        return cls(to, weight)

    def run(self, places: list[int], symbols: list[int]) -> int:
        """The weight of one clause, given the places and symbols of its words that are not "other"."""
        state, total, last = 0, 0, places[0] - 1
        for place, symbol in zip(places, symbols):
            for _ in range(min(place - last - 1, self.rests)):
                state = self.to[state, OTHER]
            total += int(self.weight[state, symbol])
            state, last = self.to[state, symbol], place
        return total


@dataclass
class Model:
    """Grades of words and beginnings, and the logistic weights; without `weights` the score is `fixed`."""

    grades: dict[str, int] = field(default_factory=dict)
    weights: list[float] | None = None
    fixed: float = 0.5


WORD = re.compile(r"[^\W_]+")
ENDS = np.isin(np.arange(128), list(b".,;:!?()\"\n\x0b\x0c\r"))
HEAD = 4  # letters by which words that may be in the lexicon are found
FIXED = {
    **dict.fromkeys(THREATS, THREATEN), **dict.fromkeys(TARGETS, TARGET), **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(SPEECH, SAY),
}
MACHINE = Machine.build()


def beginnings(word: str) -> list[str]:
    """The word and its beginnings; these are marked, so that a short word is no beginning."""
    return [word, *(word[:n] + "-" for n in STEMS if n <= len(word))]


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether a code point is a letter or a digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def head_places(heads: np.ndarray) -> np.ndarray:
    """Places in a table for the first HEAD code points of words, one row for each."""
    found = np.zeros(len(heads), np.uint64)
    for i in range(HEAD):
        found = (found ^ heads[:, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(32)
    return (found >> np.uint64(44)).astype(np.int64)


class Reader:
    """Weights of texts under a lexicon."""

    def __init__(self, grades: dict[str, int]):
        self.grades = grades
        known = {w.rstrip("-")[:HEAD] for w in [*grades, *THREATS]}
        self.gate = np.zeros(1 << 20, bool)
        self.gate[head_places(np.array([[*map(ord, w.ljust(HEAD, "\0"))] for w in known], np.uint32))] = True

    def symbol(self, word: str) -> int:
        if word in FIXED:
            return FIXED[word]
        grade = max((self.grades.get(b, 0) for b in beginnings(word)), default=0)
        return INSULT - 1 + grade if grade else OTHER

    def clauses(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """(number of the text, weight) of every clause that holds an insult or a threat."""
        lows = [(t or "").lower() for t in texts]
        whole = "\n".join(lows) + "\n"
        begins = np.cumsum([0] + [len(t) + 1 for t in lows])
        points = np.frombuffer((whole + "\0" * HEAD).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[points]
        starts = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
        heads, on = np.zeros((len(starts), HEAD), np.uint32), np.ones(len(starts), bool)
        for i in range(HEAD):
            on = on & letter[starts + i]
            heads[:, i] = np.where(on, points[starts + i], 0)
        ends = np.flatnonzero((points < 128) & ENDS[np.minimum(points, 127)])
        done = -1
        for at in starts[self.gate[head_places(heads)]].tolist():
            if at < done or not loaded(self.symbol(WORD.match(whole, at)[0])):
                continue
            nth = int(np.searchsorted(ends, at))
            start, done = int(ends[nth - 1]) + 1 if nth else 0, int(ends[nth])
            symbols = [self.symbol(m[0]) for m in WORD.finditer(whole, start, done)]
            places = [i for i, s in enumerate(symbols) if s]
            yield int(np.searchsorted(begins, at, "right")) - 1, MACHINE.run(places, [symbols[i] for i in places])

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Total weight, damped and as far as MOST, and heaviest clause of every text."""
        found = np.zeros((len(texts), 3))
        for text, weight in self.clauses(texts):
            found[text, 1] += weight
            found[text, 2] = max(found[text, 2], weight)
        found[:, 0] = np.log1p(found[:, 1])
        return np.minimum(found, MOST) / [1, 4, 4]


def training_rows(docs: DataFrame, labels: DataFrame, docs_per_class: int) -> tuple[DataFrame, list[int]]:
    """(text, label) of a bounded number of documents, and how many labels of either class there are in all."""
    known = labels.filter("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, min(1.0, 0.95 * docs_per_class / n)).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    # some 2 * docs_per_class rows of two numbers at most
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label"), [sizes.get(0, 0), sizes.get(1, 0)]


def lexicon(rows: DataFrame, size: int, least_ratio: float) -> dict[str, int]:
    """Grades of the words and beginnings that tell toxic texts from clean ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(WORD.findall((text.as_py() or "").lower()))
                seen[label].update({b for w in words for b in beginnings(w)})
            stems = list(seen[0].keys() | seen[1].keys())
            counts = [pa.array([c[s] for s in stems], pa.int64()) for c in seen]
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *counts], ["stem", "clean", "toxic"])

    sums = rows.groupBy("label").count().collect()
    n = {r["label"]: float(r["count"]) for r in sums}
    clean, toxic = n.get(0, 0.0), n.get(1, 0.0)
    if not clean or not toxic:
        return {}
    found = rows.mapInArrow(run, "stem string, clean bigint, toxic bigint").groupBy("stem")
    found = found.agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    share = f"((c + t) / {clean + toxic}D)"
    part = "case when {0} > 0 then {0} * ln({0} / ({1} * {2})) else 0 end"
    ratio = f"2 * ({part.format('t', f'{toxic}D', share)} + {part.format('c', f'{clean}D', share)})"
    odds = f"ln(((t + 0.5D) / {toxic + 1}D) / ((c + 0.5D) / {clean + 1}D)) - sqrt(1 / (t + 0.5D) + 1 / (c + 0.5D))"
    graded = found.selectExpr("stem", f"{ratio} as ratio", f"least({GRADES}, cast(floor({odds}) as int)) as grade")
    graded = graded.filter((F.col("ratio") >= least_ratio) & (F.col("grade") >= 1)).orderBy(F.desc("ratio"), "stem").limit(size)
    return unexplained([(r["stem"], r["ratio"], r["grade"]) for r in graded.collect()])


def unexplained(rows: list[tuple[str, float, int]]) -> dict[str, int]:
    """Without beginnings that tell no more than one of the words (or longer beginnings) they stand for."""
    most: dict[str, float] = {}
    for stem, ratio, _ in rows:
        for n in STEMS:
            if n < len(stem.rstrip("-")) or (n == len(stem) and not stem.endswith("-")):
                key = stem[:n] + "-"
                most[key] = max(most.get(key, 0.0), ratio)
    return {stem: grade for stem, ratio, grade in rows if ratio > most.get(stem, 0.0)}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Newton steps on the weighted log loss; the constant, in the first column, bears no penalty."""
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-9] + [ridge * weight.sum() / 100] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty @ beta
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
        step = np.linalg.solve(bend, slope)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def train(
    docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS, size: int = LEXICON, least_ratio: float = LEAST_RATIO
) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, label)."""
    rows, sizes = training_rows(docs, labels, docs_per_class)
    if not all(sizes):
        return Model(fixed=0.5 if not any(sizes) else float(sizes[1] > 0))
    rows = small_batches(rows)
    grades = lexicon(rows, size, least_ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(grades)
        for batch in (part for whole in batches for part in slabs(whole, 0)):
            told = reader.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*map(pa.array, told.T), batch.column(1)], [*FEATURES, "label"])

    counts = rows.mapInArrow(run, " double, ".join(FEATURES) + " double, label int").groupBy(*FEATURES, "label").count().toArrow()
    *told, label, n = (np.asarray(counts.column(c), np.float64) for c in (*FEATURES, "label", "count"))
    seen = [n[label == i].sum() for i in (0, 1)]
    if not all(seen):
        return Model(fixed=0.5 if not any(seen) else float(seen[1] > 0))
    weight = n * np.where(label == 1, sizes[1] / seen[1], sizes[0] / seen[0])
    order = np.lexsort((label, *told))
    x = np.stack([np.ones(len(n)), *told], axis=1)[order]
    return Model(grades, logistic(x, label[order], weight[order]).tolist())


def predict(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with the probability that a text is toxic, in place of a column that has this name."""
    docs = docs.drop(score_col)
    if model.weights is None:
        return docs.withColumn(score_col, F.lit(model.fixed))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, weights = Reader(model.grades), np.array(model.weights)
        for batch in (part for whole in batches for part in slabs(whole, at)):
            told = reader.features(batch.column(at).to_pylist())
            z = np.clip(weights[0] + told @ weights[1:], -700, 700)
            scores = pa.array(1 / (1 + np.exp(-z)))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, score_col])

    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType(), True)]))
