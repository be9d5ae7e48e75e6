from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from conftest import FOLDER, rows
from hearken.llm import negatives, phrases, queries, toxicity

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute_negatives(data, is_anchor):
    usable = {
        (i, tuple(math.floor(256 * x) for x in v), lab)
        for i, v, lab in data
        if None not in (i, v, lab) and all(x is not None and math.isfinite(256 * x) for x in v)
    }
    found = set()
    for i, v, lab in usable:
        if not is_anchor(i):
            continue
        told = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in usable if len(w) == len(v)]
        for score, j in sorted((s, j) for s, j, m in told if m == lab and j != i)[:5]:
            some = sorted((s, k) for s, k, m in told if m != lab and 50 * -score <= 100 * -s <= 95 * -score)[:3]
            found |= {(i, j, rank, k, -score, -s) for rank, (s, k) in enumerate(some, 1)}
    return sorted(found, key=repr)


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e6])
def test_negatives_equal_plain_ones(spark, scale):
    rng = np.random.default_rng(3)
    data = [(i, (rng.normal(0.2, 0.3, 6) * scale).tolist(), int(rng.integers(0, 3))) for i in range(120)]
    data += [(200 + i, data[5][1], i % 3) for i in range(8)]  # ties
    data += [data[0], data[10], (10, data[11][1], 1), (None, data[3][1], 1), (300, None, 1), (310, data[3][1], None)]
    data += [(320, [1.0, None] + data[3][1][2:], 1), (330, [math.nan] + data[3][1][1:], 1), (340, [math.inf] + data[3][1][1:], 1)]
    data += [(350, [0.5, 0.25], 1), (360, [0.5, 0.5], 1), (370, [0.25, 0.25], 2), (380, [], 1), (390, [], 2), (400, [], 1)]
    table = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as id", "'x' as comps", "map(1, 2) as anchor")
    for block in (negatives.BLOCK, 4):
        found = negatives.mine(table.repartition(3), "vec_id % 10 = 0", block=block)
        assert rows(found) == brute_negatives(data, lambda i: i % 10 == 0)


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for high in (3, 300, 1 << 20, 1 << 24, 1 << 40):
        a, b = rng.integers(-high, high, (17, 9)), rng.integers(-high, high, (23, 9))
        one = negatives.packed(b, a)
        assert one.fields > 1 or one.small
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert one.scores(a).tolist() == want


def test_no_negatives_from_empty_tables(spark):
    assert rows(negatives.mine(spark.createDataFrame([], SCHEMA), "vec_id % 10 = 0")) == []
    assert rows(negatives.mine(spark.createDataFrame([(1, [1.0], 1)], SCHEMA), "vec_id % 10 = 0")) == []


def plain_grams(docs, most):
    counts = Counter()
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall("[^ \t]+", piece)
            counts.update((lang or "und", " ".join(ws[i : i + m])) for m in range(1, most + 1) for i in range(len(ws) - m + 1))
    return counts


def brute_phrases(docs, least=3, most=3, top=2000):
    f = plain_grams(docs, most)
    n = Counter()
    for (lang, p), v in f.items():
        n[lang] += v * (" " not in p)
    kept = []
    found = [(k, v) for k, v in f.items() if " " in k[1] and v >= least]
    for (lang, p), a in found:
        if any(o == lang and len(q) > len(p) and f" {p} " in f" {q} " and 100 * b >= 50 * a for (o, q), b in found):
            continue
        ws = p.split(" ")
        cuts = []
        for k in range(1, len(ws)):
            left, right = f[lang, " ".join(ws[:k])], f[lang, " ".join(ws[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        kept.append((lang, p, a, left, right, n[lang], score))
    kept.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    seen = Counter()
    result = []
    for row in kept:
        seen[row[0]] += 1
        if seen[row[0]] <= top:
            result.append((row[0], seen[row[0]], *row[1:]))
    return sorted(result, key=repr)


@pytest.mark.parametrize(("modulus", "most"), [(1, 3), (3, 3), (32, 3), (3, 2), (3, 4)])
def test_phrases_equal_plain_ones(spark, modulus, most):
    rng = np.random.default_rng(5)
    words = ["Ab", "b", "cé", "dd", "e e", "ZZ", "q"]

    def text(n):
        return "".join(words[i] + seps for i, seps in zip(rng.integers(0, 7, n), rng.choice([" ", "  ", "\t", ", ", ".", "\n", " !? "], n, p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])))

    docs = [(str(lang), text(int(n))) for lang, n in zip(rng.choice(["en", "de"], 60), rng.integers(0, 40, 60))]
    docs += [docs[3]] * 5 + [("en", ""), ("en", None), (None, "a b c a b c a b c a b c"), ("und", "a b"), ("en", "q q q q q q q q"), ("fr", ".,;")]
    docs += [("en", text(3000))]
    table = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "map(1, 2) as chunk", "1 as own", "2 as phrase")
    found = phrases.mine(table.repartition(3), least=3, most_words=most, modulus=modulus, top=20)
    assert rows(found) == brute_phrases(docs, most=most, top=20)


def test_no_phrases_in_empty_tables(spark):
    assert rows(phrases.mine(spark.createDataFrame([], "lang string, text string"))) == []
    assert rows(phrases.mine(spark.createDataFrame([("en", None)], "lang string, text string"))) == []


def test_equal_passages_give_equal_chunks(spark):
    rng = np.random.default_rng(2)
    passage = " ".join(f"w{i}" for i in rng.integers(0, 500, 400))
    docs = [("en", f"lead{i} x{i} {passage} end{i}") for i in range(20)]
    chunks = phrases.parse(spark.createDataFrame(docs, "lang string, text string"), 3, 16)
    assert chunks.distinct().count() < chunks.count() / 5


def weigh(text, grades):
    return [w for _, w in toxicity.Reader(grades).clauses([text])]


def test_clauses_weigh_more_than_words():
    grades = {"idiot": 5, "lowei-": 3}
    assert weigh("what an idiot", grades) == [5]
    assert weigh("you are an idiot", grades) == [5 + toxicity.TARGETED]
    assert weigh("an idiot, and a fine day. IDIOT!", grades) == [5, 5]
    assert weigh("he is not an idiot", grades) == weigh("not an idiot", grades) == [0]
    assert weigh("somebody called that man an idiot", grades) == [5 + toxicity.REPORTED]
    assert weigh("i will kill you", grades) == [toxicity.THREAT]
    assert weigh("i will not kill you", grades) == weigh("they kill time every single day", grades) == [0]
    assert weigh("loweixyz there", grades) == [3]
    assert weigh("", grades) == weigh(None, grades) == weigh("idiots idiotic xlowei", {"idiot": 5}) == []
    assert toxicity.Reader(grades).features(["idiot", None, "fine", "idiot. idiot"])[:, 1].tolist() == [1.25, 0, 0, 2.5]


def test_composed_machine_equals_the_steps():
    rng = np.random.default_rng(4)
    steps = [toxicity.reported(), toxicity.negated(), toxicity.scored()]
    for _ in range(300):
        symbols = rng.choice([0, 0, 0, 1, 4, toxicity.THREATEN, toxicity.TARGET, toxicity.NEGATION, toxicity.SAY], rng.integers(1, 14)).tolist()
        states, want = [0, 0, 0], 0
        for symbol in symbols:
            for i, step in enumerate(steps):
                symbol, weight, states[i] = step.arcs[states[i], symbol]
                want += weight
        places = [i for i, s in enumerate(symbols) if s]
        got = toxicity.MACHINE.run(places, [symbols[i] for i in places]) if places else 0
        assert got == want


def test_toxicity_is_learned_from_the_labels(spark):
    scored = queries.QUERIES["op12_toxic_clauses"](spark, FOLDER.replace("0.001", "0.01"))
    labels = queries.table(spark, FOLDER.replace("0.001", "0.01"), "labels")
    docs = queries.table(spark, FOLDER.replace("0.001", "0.01"), "documents").select("doc_id", "lang")
    seen = scored.join(labels, "doc_id").join(docs, "doc_id").filter("held_out").collect()
    english = [r for r in seen if r["lang"] == "en" and r["toxic"]]
    assert sum(r["predicted"] for r in english) >= 0.85 * len(english)  # other languages have two to four training texts here
    clean = [r for r in seen if not r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r["score"] <= 1 for r in seen)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot", 0), (None, None, 1), (2, "", 1), (2, "", 1), (3, "x " * 50000 + "idiot", 2)], "doc_id bigint, text string, score int")
    docs = docs.withColumnRenamed("score", "label").selectExpr("*", "map(1, 2) as m")
    none = spark.createDataFrame([], "doc_id bigint, label int")
    assert {r["score"] for r in toxicity.predict(docs, toxicity.train(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (9, None), (None, 0)], "doc_id bigint, label int")
    assert {r["score"] for r in toxicity.predict(docs, toxicity.train(docs, ones)).collect()} == {1.0}
    model = toxicity.Model({"idiot": 5}, [-4.0, 1.0, 1.0, 1.0])
    found = toxicity.predict(docs.selectExpr("*", "'clash' as score", "1 as predicted"), model).collect()
    assert len(found) == 5 and all(isinstance(r["score"], float) for r in found)
    by_id = {r["doc_id"]: round(r["score"], 6) for r in found}
    assert by_id[None] == by_id[2] == round(1 / (1 + math.exp(4)), 6) and by_id[1] > by_id[3] > 0.1


@pytest.mark.parametrize("name", ["op5_language_cnn", "op9_quality_rules", "op12_toxic_clauses"])
def test_held_out_is_never_null(spark, tmp_path, name):
    docs = queries.table(spark, FOLDER, "documents")
    alone = spark.createDataFrame([(None, "A text without a number.")], "doc_id bigint, text string")
    docs.unionByName(alone, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    queries.table(spark, FOLDER, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    found = queries.QUERIES[name](spark, str(tmp_path)).select("doc_id", "held_out").collect()
    assert len(found) == docs.count() + 1 and {r["held_out"] for r in found} == {True, False}
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
