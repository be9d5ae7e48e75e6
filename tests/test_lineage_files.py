"""Hashes and trees of landed files, walks over lineage links, recorded manifests of vectors."""

import hashlib

import pytest
from conftest import rows

from hearken.operators import files, gate, vectors
from hearken.plans import quality


def land(folder, texts):
    for name, text in texts.items():
        at = folder / f"run={name.split('/')[0]}" / f"name={name.split('/')[1]}"
        at.mkdir(parents=True, exist_ok=True)
        (at / "part-0.bin").write_bytes(text)
    return str(folder)


TEXTS = {f"{run}/f{i}": f"{run} {i}".encode() * i for run in ("a", "b") for i in range(1, 40)}


def test_file_hashes_are_those_of_the_bytes(spark, tmp_path):
    found = files.file_hashes(spark, land(tmp_path, TEXTS))
    want = [(n.split("/")[0], n.split("/")[1], len(b), hashlib.sha256(b).hexdigest()) for n, b in TEXTS.items()]
    assert rows(found, "run", "name", "length", "sha256") == sorted(want, key=repr)


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_a_flipped_byte_changes_the_root_of_its_run_only(spark, tmp_path, levels):
    old = files.file_hashes(spark, land(tmp_path / "old", TEXTS))
    flipped = dict(TEXTS)
    flipped["a/f7"] = bytes([flipped["a/f7"][0] ^ 1]) + flipped["a/f7"][1:]
    new = files.file_hashes(spark, land(tmp_path / "new", flipped))
    before, after = (dict((r["run"], r["root"]) for r in files.roots(f, ["run"], levels=levels).collect()) for f in (old, new))
    assert before["a"] != after["a"] and before["b"] == after["b"]
    assert rows(files.changed_files(old, new, ["run"], levels=levels)) == [("a", "f7", "changed")]


def test_added_renamed_and_missing_files(spark, tmp_path):
    old = files.file_hashes(spark, land(tmp_path / "old", TEXTS))
    other = {("b/g1" if n == "b/f1" else n): b for n, b in TEXTS.items() if n != "a/f3"} | {"c/f0": b"x", "c/f1": b""}
    new = files.file_hashes(spark, land(tmp_path / "new", other))
    found = rows(files.changed_files(old, new, ["run"]))
    assert found == sorted([("a", "f3", "removed"), ("b", "f1", "removed"), ("b", "g1", "added"), ("c", "f0", "added")], key=repr)
    assert rows(files.changed_files(old, old, ["run"])) == []
    assert rows(files.roots(old.limit(0), ["run"])) == []
    shuffled = files.roots(old.repartition(7, "length"), ["run"])
    assert rows(shuffled) == rows(files.roots(old, ["run"]))


def test_walk_names_the_first_broken_link(spark):
    stages = ["raw", "clean", "vectors", "report"]

    def chain(bundle, **broken):
        return [
            (bundle, s, stages[i + 1] if i < 3 else None, broken.get(f"{s}_recorded", s), broken.get(f"{s}_actual", s), broken.get(f"{s}_used", s))
            for i, s in enumerate(stages)
        ]

    links = chain("good") + chain("both", clean_actual="x", report_actual="x") + chain("gone", report_actual=None)
    links += chain("blank", vectors_recorded=" ") + chain("input", raw_used="y") + chain("last", report_used=None)
    links += [x for x in chain("hole") if x[1] != "vectors"] + [x for x in chain("headless") if x[1] != "raw"]
    links += [("round", "raw", "clean", "h", "h", "h"), ("round", "clean", "raw", "h", "h", "h")]
    schema = "bundle_id string, stage string, next_stage string, recorded_hash string, actual_hash string, used_hash string"
    table = spark.createDataFrame(links, schema)
    bundles = table.select("bundle_id").distinct().unionByName(spark.createDataFrame([("none",)], "bundle_id string"))
    found = rows(gate.walk_chain(table, bundles, "raw", most=8), "bundle_id", "detail", "rule")
    assert found == [
        ("blank", "vectors", "not_recorded"), ("both", "clean", "output_changed"), ("gone", "report", "output_missing"),
        ("headless", "raw", "link_missing"), ("hole", "vectors", "link_missing"), ("input", "raw", "input_differs"),
        ("none", "raw", "link_missing"), ("round", "raw", "chain_in_circles"),
    ]
    assert rows(gate.walk_chain(table.limit(0), bundles.limit(0), "raw")) == []


def test_the_query_breaks_every_kind_of_link():
    kinds = {**quality.USED, **quality.RECORDED, **quality.WRITTEN, **quality.ABSENT}
    assert len(kinds) == 4 and len(quality.STAGE_NOW) == 4


def test_manifests_admit_or_refuse_vectors(spark):
    docs = spark.createDataFrame([(1, "ein wort"), (2, "zwei worte hier")], "seq bigint, review string")
    good = [(1, [0.5, 1.0]), (2, [0.25, 0.0])]

    def judged(vecs, **change):
        table = spark.createDataFrame(vecs, "vec_id bigint, embedding array<float>")
        true = vectors.embedding_manifest(docs, table).first().asDict()
        told = {"document_hash": true["document_hash"], "row_count": 2, "sbert_model": true["model"], "sbert_available": True, **change}
        manifest = spark.createDataFrame([told], "document_hash string, row_count bigint, sbert_model string, sbert_available boolean")
        refused = vectors.judge_embeddings(docs, table, manifest).first()["refused"]
        words = docs.selectExpr("*", "review as tokens")
        features = vectors.document_features(words, table, manifest)
        engines = {r["engine"] for r in features.collect()}
        assert engines == ({"words"} if refused else {"vectors"})
        return refused

    assert judged(good) is None
    assert judged(good, sbert_model="other") == judged(good, sbert_model=None) == "model_differs"
    assert judged(good, document_hash="0") == judged(good, document_hash=None) == "document_hash_differs"
    assert judged(good, row_count=3) == "row_count_differs"
    assert judged(good, sbert_available=None) == "not_available"
    assert judged(good[:1]) == "vectors_missing"
    assert judged([*good, (3, [1.0, 1.0])]) == "vectors_left_over"
    assert judged([good[0], (2, [0.1, float("nan")])]) == "broken_vectors"
    assert judged([good[0], (2, [0.1])]) == "dimensions_differ"


def test_without_one_manifest_words_are_taken(spark):
    docs = spark.createDataFrame([(1, "ein wort", "ein wort")], "seq bigint, review string, tokens string")
    table = spark.createDataFrame([(1, [0.5])], "vec_id bigint, embedding array<float>")
    none = spark.createDataFrame([], "document_hash string, row_count bigint, sbert_model string, sbert_available boolean")
    assert {r["engine"] for r in vectors.document_features(docs, table, none).collect()} == {"words"}
