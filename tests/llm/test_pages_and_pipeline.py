"""WARC archives, URL filters, SQL twins and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow.fs as pafs
import pytest
from conftest import FOLDER
from oracle import compare, duck

import corpus_pipeline
from hearken.llm import decontam, langid, lines, pieces, simhash, urls, warc
from hearken.llm.queries import ORACLES, QUERIES, URL_RULES
from hearken.session import materialize, scratch_dir

PAGES = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


ROWS = [
    (1, "http://a.example.org/x?y=1", "<p>é</p>"),
    (2, "http://a.example.org/x?y=1", "<p>é</p>"),
    (3, None, None),
    (4, "no scheme", ""),
    (5, "https://B.example.com", "z" * 300_000),
    (6, "http://b.example.com/%41\t\n", "<p>é</p>"),
    (7, "", "only"),
]


def test_warc_round_trip(spark):
    found = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(spark.createDataFrame([*ROWS, ROWS[6]], PAGES)).distinct().collect()}
    first = {}
    for page_id, _, html in ROWS:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        original = first.setdefault(data, page_id)
        kind, refers = ("response", None) if original == page_id else ("revisit", original)
        assert found[page_id] == (len(data), digest, kind, refers)


def test_small_payloads_are_not_revisits(spark):
    found = warc.round_trip(spark.createDataFrame(ROWS, PAGES), min_bytes=100)
    assert {r["record_type"] for r in found.collect()} == {"response"}


def test_archives_are_plain_gzip_members(spark):
    folder = scratch_dir(spark, "warc-test")
    captures = warc.write(spark.createDataFrame(ROWS, PAGES), folder).collect()
    store, top = pafs.FileSystem.from_uri(folder)
    for file in {c["file"] for c in captures}:
        with store.open_input_file(f"{top}/{file}") as source:
            text = gzip.decompress(source.read())
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert text.count(b"WARC/1.1\r\n") == 1 + sum(c["file"] == file for c in captures)


def test_index_finds_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(i, f"http://host{i % 9}.example.org/p%{i % 4}", "x") for i in range(300)]
    pages = spark.createDataFrame(rows, PAGES)
    folder, index_folder = scratch_dir(spark, "warc-test"), scratch_dir(spark, "cdx-test")
    captures = warc.write(pages, folder)
    index = warc.build_index(captures, index_folder)
    asked = captures.select("key", "id").unionByName(spark.createDataFrame([("org,example)/none", "5:"), ("", "1"), ("zz", "9")], "key string, id string"))
    found = warc.find(asked, index, index_folder)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, captures.select(*warc.CAPTURE).collect()))


def plain_records(rows):
    """What every row has to come back as."""
    firsts = {}
    for page_id, _, html in rows:
        if page_id is not None:
            data = (html or "").encode()
            firsts[data] = min(firsts.get(data, page_id), page_id)
    found = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = firsts.get(data)
        kind, refers = ("response", None) if first is None or first == page_id else ("revisit", first)
        found.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, refers))
    return sorted(found, key=repr)


@pytest.mark.parametrize("text_ids", [False, True])
def test_every_row_comes_back_once(spark, text_ids):
    rows = [(1, "u:x", "same"), (1, "u:y", "same"), (1, "u:y", "other"), (2, "u:x", "same"), (None, "u:z", "same"), (None, "u:z", "alone")]
    rows += [(None, "u:z", "alone"), (2, "u:x", "same"), (9, None, None), (8, "u:q", ""), *ROWS]
    if text_ids:
        rows = [(None if i is None else f"p<{i}>\t%", u, h) for i, u, h in rows]
    pages = spark.createDataFrame(rows, PAGES.replace("bigint", "string") if text_ids else PAGES)
    pages = pages.selectExpr("*", "1 as id", "2 as first", "map(1, 2) as payload").repartition(3)
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == plain_records(rows)


def test_warc_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


URLS = [
    None, "", "nothing", "http://example.org", "http://EXAMPLE.org/es/x", "http://a.b.example.org/en/1?x#y", "ftp://x.org/",
    "http://notexample.org/es/", "x://com/fr/", "http://m.y.com/de/z", "http://org", "a://b://c/d", "http://ÉX.org/", "http://x.com/" + "f" * 50_000,
]


def plain_verdict(url, rules):
    host, path = urls.host_and_path(url)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=(None, None, "allow"))
    return host, path, best[0] + best[1] if fits else None, best[2]


@pytest.mark.parametrize("max_rules", [urls.MAX_RULES, 1])
def test_url_verdicts(spark, max_rules):
    pages = spark.createDataFrame([*enumerate(URLS), (0, None), (None, URLS[4])], "page_id bigint, url string")
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block")], "host string, path string, verdict string")
    got = sorted((tuple(r) for r in urls.judge(pages, rules, max_rules=max_rules).collect()), key=repr)
    rows = [*enumerate(URLS), (0, None), (None, URLS[4])]
    assert got == sorted(((i, *plain_verdict(u, URL_RULES)) for i, u in rows), key=repr)


def test_url_filter_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert [tuple(r) for r in urls.judge(pages, rules.limit(0)).collect()] == [(1, "a.org", "/", None, "allow")]
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_colliding_digests_are_told_apart():
    arrays = urls.DigestList.arrays(URL_RULES)
    known = object.__new__(urls.DigestList)
    known.__dict__.update(arrays, lengths=arrays["lengths"].tolist())
    known.digests = arrays["digests"].copy()
    wrong = known.judge([("org", "/")])[0]
    assert wrong == ("org/", "allow")
    known.strings = known.strings.copy()
    known.strings[:] = 0
    assert known.judge([("org", "/")])[0] == (None, None)


def test_pipeline_stages_and_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "piece_encoding",
    ]
    items = [(r["item_id"], decontam.words_of(r["text"]).tolist()) for r in bench.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, FOLDER), name)
        assert after.columns == docs.columns
        had, got = ({r["doc_id"]: r for r in d.collect()} for d in (docs, after))
        if name == "language_id":
            assert all(langid.has_letter(r["text"]) for r in got.values())
            assert len(got) >= 0.99 * sum(langid.has_letter(r["text"]) for r in had.values())
        elif name == "line_dedup":
            held = {}
            for i in sorted(had):
                keep = []
                for line in had[i]["text"].split("\n"):
                    key = line.strip(lines.SPACES).translate({c: c + 32 for c in range(65, 91)})
                    if len(key) < lines.MIN_CHARS or held.setdefault(key, i) == i:
                        keep.append(line)
                assert got[i]["text"] == "\n".join(keep) and got[i]["n_chars"] == len("\n".join(keep))
        elif name == "simhash_near_dedup":
            prints = {i: simhash.fingerprint(r["text"]) for i, r in had.items()}
            root = {i: i for i in had}
            for a in sorted(had):  # smallest reachable document
                todo = [a] if root[a] == a else []
                while todo:
                    b = todo.pop()
                    for c in had:
                        if root[c] == c and c > a and (prints[b] ^ prints[c]).bit_count() <= 3:
                            root[c] = a
                            todo.append(c)
            assert set(got) == {i for i in had if root[i] == i}
        else:
            for i, r in had.items():
                text = decontam.words_of(r["text"])
                dirty = False
                for _, item in items:
                    masks = {}
                    for k, w in enumerate(item):
                        masks[w] = masks.get(w, 0) | 1 << k
                    dirty |= len(item) >= decontam.MIN_WORDS and decontam.distance(item, masks, text) <= int(0.2 * len(item) + 1e-9)
                assert (i in got) == (not dirty)
        docs = after
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    voc = pieces.vocabulary(pieces.model_path())
    assert len(encoded) == docs.count()
    assert all(r["round_trip"] and voc.decode(r["ids"]) == r["text"] for r in encoded)


def test_pipeline_edges(spark, tmp_path):
    rows = [(1, "plain words in a row", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "some other words", "en", None, 1), (1, "plain words in a row", "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=repr) == sorted([(1, "plain words in a row"), (None, "some other words")], key=repr)
    assert all(r["round_trip"] for r in found)
