"""A quality classifier as a sparse ensemble of rules.

Statistics of every whole text are computed once. A random forest of shallow trees is grown on the labelled rows; every
path from a root to a node is a rule, a conjunction of comparisons of statistics with thresholds. A logistic model with a
lasso penalty weighs all rules at once and drops most of them. The rest are compiled into one Spark column expression, so
scoring is a plain projection of the statistics.

Forest and lasso are Spark's, trained on all labelled rows, distributed.

Defined results: a null or empty text has all statistics zero and gets a score like any other. Rows without a label or
without a match in the labels teach nothing; repeated labels count as often as they stand there. If the labels hold one
class only (or none), the score is that class (or 0.5) for every text. Further columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.batches import small_batches

STATISTICS = [
    "n_chars", "n_words", "mean_word", "long_words", "distinct_words", "top_word", "upper", "digits", "marks", "symbols",
    "pipes", "exclamations", "spaces", "lines_per_word", "line_repeats", "not_ascii", "entropy", "ends_in_mark", "no_letters",
]
TREES = 24
DEPTH = 3
PENALTY = 0.0005
SEED = 7

Rule = tuple[tuple[int, str, float], ...]  # (statistic, "<=" or ">", threshold)
Rules = tuple[float, list[tuple[Rule, float]]]  # intercept, weighted rules

CODES = np.arange(256)
UPPER = (CODES >= 65) & (CODES <= 90)
DIGIT = (CODES >= 48) & (CODES <= 57)
SPACE = (CODES == 32) | ((CODES >= 9) & (CODES <= 13))
MARK = np.isin(CODES, list(b".,;:!?'\"()-"))
SYMBOL = (CODES > 32) & (CODES < 127) & ~MARK & ~DIGIT & ~UPPER & ~((CODES >= 97) & (CODES <= 122))
ENDS = tuple(b".,;:!?#$%&*|")


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [float(len(text or ""))] + [0.0] * (len(STATISTICS) - 1)
    size, n = len(data), len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / size
    lines = data.split(b"\n")
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lasts = np.frombuffer(bytes([w[-1] for w in words]), np.uint8)
    return [
        float(len(text)),
        float(n),
        float(lengths.mean()),
        float((lengths > 14).mean()),
        len(seen) / n,
        max(seen.values()) / n,
        counts[UPPER].sum() / size,
        counts[DIGIT].sum() / size,
        counts[MARK].sum() / size,
        counts[SYMBOL].sum() / size,
        counts[124] / n,
        counts[33] / n,
        counts[SPACE].sum() / size,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        counts[128:].sum() / size,
        float(-(share * np.log2(share)).sum()),
        float(np.isin(lasts, ENDS).mean()),
        sum(w in (b"|", b"-", b"#") for w in seen) / n,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], ["id", "stats"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"id {kind}, stats array<double>").withColumnRenamed("id", id_col)


def paths(tree: str) -> list[Rule]:
    """All rules of one tree, from its printed form: an indented If/Else for every split."""
    found: list[Rule] = []
    above: list[tuple[int, tuple[int, str, float]]] = []
    for line in tree.splitlines():
        if m := re.match(r"( +)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            while above and above[-1][0] >= len(m[1]):
                above.pop()
            above.append((len(m[1]), (int(m[2]), m[3], float(m[4]))))
            found.append(tuple(x for _, x in above))
    return found


def holds(rule: Rule, stats: Column) -> Column:
    tests = [stats[i] <= value if sign == "<=" else stats[i] > value for i, sign, value in rule]
    every = tests[0]
    for test in tests[1:]:
        every = every & test
    return every


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Rules:
    """Weighted rules from rows (stats, label)."""
    rows = rows.filter("label is not null").select("stats", F.col("label").cast("double").alias("label"))
    seen = [r[0] for r in rows.groupBy("label").count().select("label").collect()]
    if len(seen) < 2:
        return (30.0 if seen[0] else -30.0) if seen else 0.0, []
    ready = rows.withColumn("features", array_to_vector("stats"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.7, seed=SEED).fit(ready)
    rules = sorted({rule for tree in forest.trees for rule in paths(tree.toDebugString)})
    fired = rows.withColumn("features", array_to_vector(F.array(*[holds(r, F.col("stats")).cast("double") for r in rules])))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=80, standardization=False).fit(fired.select("features", "label"))
    weights = lasso.coefficients.toArray()
    return float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w]


def score(rules: Rules, stats: Column) -> Column:
    """The probability of label 1 as one column expression."""
    intercept, weighted = rules
    total = F.lit(intercept)
    for rule, weight in weighted:
        total = total + F.when(holds(rule, stats), weight).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score_one(rules: Rules, stats: list[float]) -> float:
    """The same for one row of statistics."""
    intercept, weighted = rules
    total = intercept
    for rule, weight in weighted:
        total += weight if all(stats[i] <= v if sign == "<=" else stats[i] > v for i, sign, v in rule) else 0.0
    return 1 / (1 + math.exp(-total))
