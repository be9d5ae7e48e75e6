"""Language network, quality rules, licences, decontamination and piece encoding."""

from __future__ import annotations

import random
import textwrap

import numpy as np
import pyarrow as pa
import pytest

from hearken.llm import decontam, langid, licenses, pieces, quality
from hearken.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, lang string"
FOLDER = "/root/testdata/sf0.001"


def test_languages_on_held_out_documents(spark):
    found = QUERIES["op5_language_cnn"](spark, FOLDER)
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter("held_out").collect()
    assert rows and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_unknown_language_and_edges(spark):
    rows = [(1, "wow this here", "en"), (2, "ja das hier", "de"), (3, None, "en"), (4, "123 !?", None), (5, "", "de"), (None, "x" * 200_000, "en")]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs.select("doc_id", "text"), langid.train(docs)).collect()}
    assert [found[i] for i in (3, 4, 5)] == [("und", 0.0)] * 3
    assert found[1][0] in ("en", "de") and found[None][0] in ("en", "de")
    nothing = langid.train(docs.filter("lang = 'xx'"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    data, labels = rng.integers(97, 105, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    p = {"bytes": rng.normal(size=(256, langid.DIMENSIONS)), "out": rng.normal(size=(langid.FILTERS * 3, 2)), "bias": np.zeros(2)}
    for w in langid.WIDTHS:
        p[f"w{w}"], p[f"b{w}"] = rng.normal(size=(w * langid.DIMENSIONS, langid.FILTERS)), rng.normal(size=langid.FILTERS)
    weight = np.ones(2)

    def loss():
        model = {**p, "names": ["a", "b"]}
        tables = {k: v.astype(np.float64) for k, v in langid.pair_tables(model).items()}
        return -np.log(langid.window_chances(model, tables, data)[np.arange(6), labels]).mean()

    grads = langid.gradients({k: v.copy() for k, v in p.items()}, data, labels, weight)
    for name, at in (("w3", (4, 2)), ("b2", (3,)), ("out", (5, 1)), ("bytes", (100, 1)), ("bias", (0,))):
        step = 1e-3 if name == "bytes" else 1e-4
        p[name][at] += step
        up = loss()
        p[name][at] -= 2 * step
        down = loss()
        p[name][at] += step
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-2, rel=5e-2)


def test_quality_on_held_out_documents(spark):
    scored = QUERIES["op9_quality_rules"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)


def test_compiled_rules_equal_plain_ones(spark):
    texts = [None, "", "   ", "A b. C!", "| | |", "word " * 500, "x" * 100_000, "é\nù\nù"]
    stats = quality.with_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    rules = (0.3, [(((0, ">", 5.0), (4, "<=", 0.9)), 1.5), (((16, ">", 1.0),), -2.0)])
    for r in stats.select("doc_id", "stats", quality.score(rules, stats["stats"]).alias("score")).collect():
        assert r["stats"] == quality.statistics(texts[r["doc_id"]])
        assert r["score"] == pytest.approx(quality.score_one(rules, r["stats"]))


def test_one_class_and_no_labels(spark):
    schema = "stats array<double>, label int"
    zeros = [0.0] * len(quality.STATISTICS)
    assert quality.fit(spark.createDataFrame([(zeros, 1)], schema)) == (30.0, [])
    assert quality.fit(spark.createDataFrame([], schema)) == (0.0, [])


def test_paths_of_a_tree():
    tree = "  If (feature 2 <= 0.5)\n   If (feature 0 <= 1.0)\n    Predict: 0.0\n   Else (feature 0 > 1.0)\n    Predict: 1.0\n  Else (feature 2 > 0.5)\n   Predict: 1.0\n"
    a, b, c = (2, "<=", 0.5), (0, "<=", 1.0), (0, ">", 1.0)
    assert quality.paths(tree) == [(a,), (a, b), (a, c), ((2, ">", 0.5),)]


def test_licences(spark):
    bsd = "\n".join([licenses.REDISTRIBUTION, licenses.SOURCE_FORM, licenses.BINARY_FORM])
    rows = [
        (1, f"Copyright me.\n{bsd.upper()}\n{licenses.ENDORSEMENT}"),
        (2, bsd),
        (3, "Text. RELEASED under the MIT  License.!! More text"),
        (4, "released under the mit license"),
        (5, None),
        (6, ""),
        (7, "All rights reserved. Licensed under CC BY-NC 4.0. All rights reserved."),
        (8, f"{licenses.BINARY_FORM} {licenses.SOURCE_FORM} {licenses.REDISTRIBUTION}"),
        (9, "x " * 50_000 + "\nAll rights reserved."),
        (None, licenses.GRANT + " " + licenses.NOTICE),
        (2, bsd),
    ]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, sentence int")
    found = licenses.scan(docs)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    got = sorted(((r["doc_id"], r["licenses"]) for r in found.collect()), key=repr)
    reserved = "LicenseRef-All-Rights-Reserved"
    want = {1: "BSD-3-Clause", 2: "BSD-2-Clause", 3: "MIT", 4: "MIT", 7: f"CC-BY-NC-4.0 {reserved}", 9: reserved, None: "MIT"}
    assert got == sorted(((i, want.get(i, "")) for i, _ in rows), key=repr)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_wrapped_and_commented_licences(spark):
    def wrapped(*parts, mark="", width=70, gap="\n\n"):
        lines = gap.join(textwrap.fill(p, width - len(mark)) for p in parts).split("\n")
        return "\n".join((mark + line).rstrip() for line in lines)

    mit = ("MIT License", "Copyright (c) 2020 Someone", licenses.GRANT, licenses.NOTICE)
    bsd = [licenses.REDISTRIBUTION, "1. " + licenses.SOURCE_FORM, "2. " + licenses.BINARY_FORM]
    gpl = f"{licenses.GPL_FREE} {licenses.GPL_3}"
    rows = [(wrapped(*mit, mark=m, width=w, gap=g), "MIT") for m in ("", " * ", "# ", "// ", ";; ", "! ", "dnl ", "REM ") for w in (40, 76) for g in ("\n", "\n\n")]
    rows += [
        (wrapped(*mit).replace("\n", "\r\n"), "MIT"),
        ("/* " + wrapped(*mit, mark=" * ") + "\n */\nint x;", "MIT"),
        (wrapped(*bsd), "BSD-2-Clause"),
        (wrapped(*bsd, "3. " + licenses.ENDORSEMENT, mark="// "), "BSD-3-Clause"),
        (wrapped(licenses.ISC_GRANT), "ISC"),
        (licenses.ISC_GRANT.replace("granted, ", "granted,\n"), "ISC"),
        (licenses.ZERO_GRANT + "\nprovided by nobody", "0BSD"),
        (wrapped(gpl, mark="# "), "GPL-3.0-or-later"),
        (wrapped(f"{licenses.GPL_OLD} {licenses.GPL_2}"), "GPL-2.0-or-later"),
        (wrapped(licenses.APACHE_FILE + " " + licenses.APACHE_USE, mark="# ", width=50), "Apache-2.0"),
        (licenses.ISC_GRANT.replace("fee is", "fee\n\nis"), ""),
        ("we say: all rights reserved\nreleased under | the\nMIT license", "MIT LicenseRef-All-Rights-Reserved"),
        ("not all rights reserved\nor all rights\nreserved", ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id int, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()}
    assert [(t, got[i]) for i, (t, want) in enumerate(rows) if got[i] != want] == []


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def plain_distance(item, text):
    before = [0] * (len(text) + 1)
    for a in item:
        now = [before[0] + 1]
        for j, b in enumerate(text):
            now.append(min(before[j] + (a != b), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)


def test_bit_parallel_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item, text = (rng.integers(0, 6, rng.integers(a, 40)).astype(np.uint32) for a in (5, 0))
        masks = {}
        for i, w in enumerate(item.tolist()):
            masks[w] = masks.get(w, 0) | 1 << i
        assert decontam.distance(item, masks, text) == plain_distance(item.tolist(), text.tolist())


def test_recall_at_the_limit_and_no_false_match():
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, rng.randint(5, 60)))) for i in range(80)]
    index = decontam.ItemIndex(items)
    found = wanted = 0
    for i, text in items:
        changed = text.split()
        for _ in range(int(0.2 * len(changed))):
            at = rng.randrange(len(changed))
            changed[at : at + 1] = rng.choice([[], ["zz"], [changed[at], "yy"]])
        doc = " ".join(words(rng, 40) + changed + words(rng, 40))
        hits = {index.ids[item]: far for _, item, far in index.search([doc])}
        wanted += 1
        found += i in hits
        for item, far in hits.items():
            assert far == plain_distance(items[item][1].split(), doc.split()) <= 0.2 * len(items[item][1].split())
    assert found >= 0.95 * wanted


@pytest.mark.parametrize("between", [[""], ["one"], [""] * 300, ["one", "", "two", ""]])
def test_cut_copies_behind_any_neighbours(between):
    rng = random.Random(3)
    item = words(rng, 30)
    index = decontam.ItemIndex([(4, " ".join(item))])
    head = [" ".join(words(rng, 50)), *between, " ".join(item[2:] + words(rng, 2)), *between, " ".join(words(rng, 10))]
    start = 50 + sum(map(len, map(str.split, between)))
    index.candidates = lambda _: np.array([[0, start - 2]])  # one alignment only, that of the words that are left
    assert list(index.search(head)) == [(1 + len(between), 0, 2)]
    tail = [" ".join(words(rng, 50) + item[:-2]), *between, " ".join(words(rng, 50))]
    index.candidates = lambda _: np.array([[0, 50]])
    assert list(index.search(tail)) == [(0, 0, 2)]


def test_contaminations_edges(spark, monkeypatch):
    rng = random.Random(9)
    item = " ".join(words(rng, 20))
    monkeypatch.setattr(decontam, "PIECE", 5000)
    rows = [(1, f"start {item.upper()}!! end", "a"), (2, None, "b"), (3, "", "c"), (4, " ".join(words(rng, 3000)) + " " + item, "d")]
    rows += [(5, " ".join(words(rng, 200)), "e"), (None, item, "f"), (1, rows[0][1], "a"), (6, item[: len(item) // 2], "g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "too short"), (13, ""), (None, item)], "item_id bigint, text string")
    found = sorted((r["doc_id"], r["item_id"], r["distance"], r["similarity"]) for r in decontam.contaminations(docs, bench).collect())
    assert found == [(1, 10, 0, 1.0), (4, 10, 0, 1.0)]
    blocks = decontam.contaminations(docs, bench, max_items=1)
    assert sorted((r["doc_id"], r["item_id"]) for r in blocks.collect()) == [(1, 10), (4, 10)]
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["item"] for r in kept.collect()) == ["b", "c", "e", "g"]
    assert decontam.clean(docs, bench.limit(0)).count() == len(rows)
    assert decontam.contaminations(docs.limit(0), bench).count() == 0


def test_distances_of_many_items_are_those_of_one():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 2, 5, 9, 31, 63, 64, 64])
    items = [rng.integers(0, 6, n).astype(np.uint32) for n in sizes]
    regions = [rng.integers(0, 6, 90).astype(np.uint32) for _ in sizes]
    regions[5][10:73] = items[5]
    places = [{w: sum(1 << i for i, x in enumerate(item.tolist()) if x == w) for w in range(6)} for item in items]
    masks = np.array([[places[k].get(int(w), 0) for k, w in enumerate(step)] for step in zip(*regions)], np.uint64)
    wanted = [decontam.distance(item, place, region) for item, place, region in zip(items, places, regions)]
    assert decontam.distances(masks, sizes).tolist() == wanted and wanted[5] == 0


def published():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


ODD = ["", " ", "   ", "a  b   c", "ab▁c ▁▁ d", "　x", "☃ ☃☃", "日本語のテキスト" * 40, "x" * 500, "aAaA" * 200, "\n\n  \n", "🙂🙂 ok", "the" * 90]


@pytest.mark.parametrize("chunk", [3, 7, 50, 100_000])
def test_chunks_give_the_published_identifiers(monkeypatch, chunk):
    monkeypatch.setattr(pieces, "CHUNK", chunk)
    voc, model = pieces.vocabulary(pieces.model_path()), published()
    rng = random.Random(chunk)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "漢", "▁", "1", "tion", "☃"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for text in texts:
        ids = pieces.encode_chunks(voc, text)
        assert ids == model.encode(text)
        assert voc.decode(ids) == text.replace("▁", " ")


def test_words_of_a_batch_are_encoded_together():
    voc, model = pieces.vocabulary(pieces.model_path()), published()
    texts = [None, *ODD, None, "end "]
    spaced = pieces.spaced(pa.array(texts, pa.string()))
    ids, bounds = pieces.encode_array(voc, spaced)
    found = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert found == [model.encode(t or "") for t in texts]
    assert pieces.gives_back(voc, spaced, ids, bounds).all()
    other = ids.copy()
    other[-1] = voc.ids["a"]
    assert pieces.gives_back(voc, spaced, other, bounds).tolist() == [True] * (len(texts) - 1) + [False]
    again, where = pieces.encode_array(voc, spaced.slice(3, 5))
    assert [again[a:b].tolist() for a, b in zip(where, where[1:])] == found[3:8]
    assert pieces.encode_array(voc, pieces.spaced(pa.array([], pa.string())))[1].tolist() == [0]


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((5, 5)) < 0.4, pieces.NEVER, rng.integers(-9, 0, (5, 5))) for _ in range(3))
    assert (pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))).all()


def test_encode_table(spark, monkeypatch):
    monkeypatch.setattr(pieces, "GROUP", 3)
    giant = "Some words and 漢字 in  a row. " * 6000
    rows = [(1, "Hello there", 5), (2, None, 6), (3, "", 7), (4, giant, 8), (None, "x" * 40_000, 9), (4, giant, 8), (5, "a▁b", 1)]
    rows += [(10 + i, ("It was so. " * pieces.CHUNK)[: pieces.CHUNK + i], 0) for i in (-2, -1, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_ids int")
    counts = {r["doc_id"]: r["n"] for r in docs.select("doc_id", pieces.n_chunks(docs["text"]).alias("n")).collect()}
    assert [counts[i] for i in (1, 2, 3, 8, 9, 10, 11)] == [1, None, 0, 1, 1, 2, 2] and counts[4] > 20
    found = pieces.round_trip(docs)
    assert found.columns == ["doc_id", "text", "ids", "n_ids", "round_trip"]
    model = published()
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        if r["text"] is None:
            assert r["ids"] is None and r["round_trip"] is None
        else:
            assert r["ids"] == model.encode(r["text"]) and r["n_ids"] == len(r["ids"]) and r["round_trip"]
    assert pieces.round_trip(docs.limit(0)).count() == 0
