"""SimHash groups, line deduplication, embedding links and components against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from hearken.llm import components, lines, pivots, simhash

DOCS = "doc_id bigint, text string"


def union(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    edges += [(rng.randrange(300, 380), rng.randrange(300, 380)) for _ in range(50)]
    ids = sorted({x for e in edges for x in e} | {999})
    nodes = spark.createDataFrame([(i, i) for i in ids], "id bigint, first bigint")
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint"), nodes)
    assert {r["id"]: r["first"] for r in found.collect()} == union(edges, ids)


def test_components_without_edges(spark):
    nodes = spark.createDataFrame([(3, 7)], "id bigint, first bigint")
    found = components.components(spark.createDataFrame([], "a bigint, b bigint"), nodes).collect()
    assert [tuple(r) for r in found] == [(3, 7)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two", "a b c", "ÄÖ a\x0bb A b  c " * 30, "x " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_golay_keys_meet_every_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    other = base.copy()
    for _ in range(3):
        other ^= np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)
    rows, stored = simhash.keys(base, False)
    probe_rows, probes = simhash.keys(other, True)
    known = {(r, k) for r, k in zip(rows.tolist(), stored.tolist())}
    met = {r for r, k in zip(probe_rows.tolist(), probes.tolist()) if (r, k) in known}
    assert met == set(range(3000))


def test_golay_code_is_perfect():
    words = np.arange(1 << 12) << 7
    indices, counts = simhash.codeword_indices(words)
    assert set(np.unique(counts)) == {1, 6}
    assert all(len(set(row.tolist())) == 6 for row in indices[counts == 6][:100])


def test_groups_against_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(120)) for _ in range(15)]
    texts = [*base, *base[:5], None, "", "  ", "one two"]
    for t in base[:10]:
        words = t.split()
        for _ in range(3):
            changed = list(words)
            changed[rng.randrange(len(words))] = "new"
            texts.append(" ".join(changed))
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(1, texts[0]), (None, texts[1])]
    found = simhash.groups(spark.createDataFrame(rows, DOCS)).collect()
    prints = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = union(links, sorted(prints))
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["fingerprint"] == f"{plain_fingerprint(texts[1]):016x}"
        else:
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])


def test_keep_first(spark):
    rows = [(5, "a b c d", "x"), (2, "a b c d", "y"), (2, "a b c d", "y"), (9, "other words in here", None), (None, "a b c d", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    kept = sorted(map(tuple, simhash.keep_first(docs).collect()), key=repr)
    assert kept == sorted([(2, "a b c d", "y"), (9, "other words in here", None), (None, "a b c d", "z")], key=repr)


@pytest.mark.parametrize("small", [simhash.SMALL, 2])
def test_keep_first_joins_near_copies_that_three_bits_miss(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.choice([3, 30, 200]))) for _ in range(12)]
    for t in texts[:12]:
        for n in (1, 2, 4, 8):
            changed = t.split()
            for at in rng.sample(range(len(changed)), min(n, len(changed))):
                changed[at] = "new"
            texts.append(" ".join(changed))
    texts += [None, "", " "]
    sets = [simhash.shingle_set(t, 5)[1].tolist() for t in texts]
    plain = {}
    for t in texts:
        w = (t or "").lower().split()
        plain[t] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    assert [len(s) for s in sets] == [len(plain[t]) for t in texts]
    ids = range(len(texts))
    links = [(a, b) for b in ids for a in range(b) if len(plain[texts[a]] & plain[texts[b]]) >= 0.8 * len(plain[texts[a]] | plain[texts[b]])]
    assert sum((simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() > 3 for a, b in links) >= 4
    want = union(links, ids)
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], DOCS)
    kept = simhash.keep_first(docs)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [i for i in ids if want[i] == i]
    assert kept.filter("doc_id is null").count() == 1
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_groups_of_nothing(spark):
    assert simhash.groups(spark.createDataFrame([], DOCS)).count() == 0


def plain_line_dedup(rows):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(lines.SPACES))

    firsts, seen = {}, {}
    for i, text in rows:
        if i is not None:
            for k in {key(x) for x in (text or "").split("\n")}:
                seen.setdefault(k, set()).add(i)
    firsts = {k: min(v) for k, v in seen.items() if len(v) > 1 and len(k) >= 10}
    found = []
    for i, text in rows:
        cut = (text or "").split("\n")
        kept = [x for x in cut if i is None or firsts.get(key(x), i) >= i]
        found.append((i, len(cut), len(cut) - len(kept), "\n".join(kept)))
    return sorted(found, key=repr)


LINES = ["The same line again", "  the SAME line again\t", "short", "Ünïcode repeated line", "x" * 5000, "", "another thing here", "ÜNÏCODE repeated line"]


@pytest.mark.parametrize("broadcast_bytes", [lines.BROADCAST_BYTES, 0])
def test_line_dedup_against_brute_force(spark, broadcast_bytes):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice([*LINES, f"line number {rng.random()}"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "\n\n"), (3, rows[3][1]), (None, "The same line again\nshort")]
    docs = spark.createDataFrame([(i, t, "k", [1]) for i, t in rows], "doc_id bigint, text string, line string, hash array<int>")
    found = lines.dedup(docs, broadcast_bytes=broadcast_bytes)
    assert found.columns == ["doc_id", "text", "line", "hash", "n_lines", "n_dropped"]
    got = sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in found.collect()], key=repr)
    assert got == plain_line_dedup(rows)


def test_line_dedup_of_nothing(spark):
    assert lines.dedup(spark.createDataFrame([], DOCS)).count() == 0
    assert lines.dedup(spark.createDataFrame([(1, None)], DOCS)).collect()[0]["text"] is None


def test_once_filter_misses_no_repeat():
    rng = np.random.default_rng(0)
    pieces = [rng.integers(0, 5000, 700).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(12)]
    once = lines.Bloom(100)  # far too small: many false suspects, but no miss
    suspected = set(np.concatenate([lines.seen_twice(once, p) for p in pieces]).tolist())
    values, counts = np.unique(np.concatenate(pieces), return_counts=True)
    assert set(values[counts > 1].tolist()) <= suspected


def test_long_texts_pass_in_slabs():
    texts = pa.array(["a" * 10, None, "b" * (lines.SLAB + 5), "c"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), texts], ["id", "text"])
    assert sum((s.column(0).to_pylist() for s in lines.slabs(batch, 1)), []) == [0, 1, 2, 3]


def plain_links(rows, least=0.93):
    vectors = {}
    for i, e, label in rows:
        if i is not None and label is not None and e and None not in e and np.isfinite(e).all() and np.any(e):
            vectors[i] = (np.array(e, float), label)
    pairs = []
    for a in vectors:
        for b in vectors:
            (u, x), (v, y) = vectors[a], vectors[b]
            if a < b and x == y and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= least:
                pairs.append((a, b))
    ids = sorted({i for i, _, _ in rows if i is not None})
    root = union(pairs, ids)
    return {i: (sum(i in p for p in pairs), root[i], root[i] == i) for i in ids}


@pytest.mark.parametrize(("cell", "block"), [(1024, 2048), (20, 8)])
def test_range_join_against_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(pivots, "CELL", cell)
    monkeypatch.setattr(pivots, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.15).tolist(), int(i % 2)) for i in range(200)]
    rows += [(200 + i, rows[0][1], 0) for i in range(12)]  # copies
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [1.0, None] * 4, 0), (303, [float("nan")] * 8, 0), (304, rows[1][1], None)]
    rows += [(305, [1.0, 2.0], 0), (306, [2.0, 4.0], 0), (307, [], 0), (308, [-0.0, 1.0], 0), (309, [0.0, 1.0], 0)]
    df = spark.createDataFrame([*rows, (None, rows[0][1], 0), rows[5]], "vec_id bigint, embedding array<double>, label int")
    found = pivots.near_duplicates(df.withColumn("space", df["label"])).collect()
    want = plain_links(rows)
    assert len(found) == len(rows) + 2
    for r in found:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == want[r["vec_id"]]


def test_range_join_of_nothing(spark):
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_kept_text_digest_matches_contract(spark):
    kept = lines.dedup(spark.createDataFrame([(1, "a long enough line"), (2, "A long enough line \nrest")], DOCS))
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts == {1: "a long enough line", 2: "rest"}
    assert hashlib.sha256(texts[2].encode()).hexdigest() == hashlib.sha256(b"rest").hexdigest()


def test_linked_fingerprints_are_candidates_without_a_shared_band(spark):
    rows = [(1, 0b0111, 9, [11]), (2, 0, 9, [12]), (3, 0b1111 << 20, 9, [13]), (4, 0, 9, [14]), (5, 0, 90, [15])]
    prints = spark.createDataFrame(rows, "print bigint, fingerprint bigint, size int, keys array<bigint>")
    found = {frozenset((r["lead"], r["other"])) for r in simhash.candidates(prints).collect()}
    assert found == {frozenset((1, 2)), frozenset((1, 4)), frozenset((2, 4))}


@pytest.mark.parametrize("text", [None, "", "one", "a b c d e", "A b  c d e f g " * 40])
def test_one_pass_gives_fingerprint_and_shingles(text):
    whole, hashes = simhash.shingle_hashes(text, 5)
    words = (text or "").lower().split()
    assert len(hashes) == (max(len(words) - 4, 1) if words else 0)
    assert simhash.majority(hashes) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))
    assert simhash.shingle_set(text, 5)[0] == whole
