"""URL filters on a sorted array of digests.

A list of rules (host, path, verdict) becomes three flat files: the XXH64 digests of the rule strings, ascending; the
strings themselves in the same order; their verdicts. Tasks map the files into memory (the pages are shared by all
workers of a machine and read on demand). A url is probed by every parent of its host with every path length that some
rule has; all probes of a batch go through one vectorised binary search, hits are confirmed by comparing the whole
strings, and the longest confirmed rule wins.

The files go to the executors with `addFile` from the shared folder. The list is counted first: up to `max_rules` it is
mapped; beyond that the probes of the urls meet the rules in a shuffled join on digest and string.

Defined results: the host stands after the first `://`, up to `/`, `?`, `#` or the end, with A-Z lower-cased; the path
follows, up to `?`, `#` or the end; both are empty without `://` or for a null url. A url that no rule fits gets the
default verdict and a null rule. Rules of equal length are told apart by the longer host. Of rules given twice the
one with the greater verdict (block before allow) counts; rules with a null host or path are ignored. Repeated pages
are judged each for itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.session import scratch_dir

MAX_RULES = 1 << 22
SPLIT = re.compile(r"://([^/?#]*)([^?#]*)")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def host_and_path(url: str | None) -> tuple[str, str]:
    found = SPLIT.search(url) if url else None
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def probes(host: str, path: str, lengths: list[int]) -> list[tuple[str, int]]:
    """(rule string, size of its host), longest first, for all rules that could fit."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))] if host else []
    found = [(h + path[:n], len(h)) for h in hosts for n in lengths if n <= len(path)]
    return sorted(found, key=lambda x: (-len(x[0]), -x[1]))


class DigestList:
    """Sorted digests, whole rule strings and verdicts, mapped from files."""

    def __init__(self, place: Callable[[str], str]):
        """`place` names the file of a part."""
        self.digests, self.ends, self.strings, self.verdicts = (
            np.load(place(part), mmap_mode="r") for part in ("digests", "ends", "strings", "verdicts")
        )
        self.lengths = np.load(place("lengths")).tolist()

    @staticmethod
    def arrays(rules: list[tuple[str, str, str]]) -> dict[str, np.ndarray]:
        """The files' contents for (host, path, verdict) rows."""
        unique: dict[tuple[str, int], str] = {}
        for host, path, verdict in rules:
            name = (host + path, len(host))
            unique[name] = max(unique.get(name, ""), verdict)
        rows = sorted((xxhash.xxh64_intdigest(f"{size} {name}"), f"{size} {name}", v) for (name, size), v in unique.items())
        strings = [s.encode() for _, s, _ in rows]
        return {
            "digests": np.array([d for d, _, _ in rows], np.uint64),
            "strings": np.frombuffer(b"".join(strings), np.uint8),
            "ends": np.cumsum([0, *map(len, strings)]),
            "verdicts": np.array([v == "allow" for _, _, v in rows], bool),
            "lengths": np.array(sorted({len(n) - size for n, size in unique}), np.int64),
        }

    def string(self, at: int) -> bytes:
        return self.strings[self.ends[at] : self.ends[at + 1]].tobytes()

    def judge(self, pairs: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """(rule string, verdict) for each (host, path); nulls where no rule fits."""
        owner, wanted = [], []
        for row, (host, path) in enumerate(pairs):
            for name, size in probes(host, path, self.lengths):
                owner.append(row)
                wanted.append((name, size))
        found: list[tuple[str | None, str | None]] = [(None, None)] * len(pairs)
        if not wanted or not len(self.digests):
            return found
        keys = [f"{size} {name}" for name, size in wanted]
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        first = np.searchsorted(self.digests, digests, "left")
        last = np.searchsorted(self.digests, digests, "right")
        for probe in np.flatnonzero(last > first):
            row = owner[probe]
            if found[row][0] is None:  # longer rules come first
                for at in range(first[probe], last[probe]):
                    if self.string(at) == keys[probe].encode():
                        found[row] = (wanted[probe][0], "allow" if self.verdicts[at] else "block")
        return found


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for pages (page_id, url) by rules (host, path, verdict)."""
    rules = rules.filter("host is not null and path is not null").select("host", "path", "verdict")
    if not 0 < rules.count() <= max_rules:
        return judge_by_join(pages, rules, default)
    spark = pages.sparkSession
    base = scratch_dir(spark, "digests")
    store, top = pafs.FileSystem.from_uri(base)
    name = top.rsplit("/", 1)[1]
    store.create_dir(top, recursive=True)
    listed = rules.toArrow().to_pylist()
    for part, values in DigestList.arrays([(r["host"], r["path"], r["verdict"]) for r in listed]).items():
        with store.open_output_stream(f"{top}/{name}-{part}.npy", compression=None) as out:
            np.save(out, values)
        spark.sparkContext.addFile(f"{base}/{name}-{part}.npy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = DigestList(lambda part: SparkFiles.get(f"{name}-{part}.npy"))
        for batch in batches:
            pairs = [host_and_path(u) for u in batch.column(1).to_pylist()]
            judged = known.judge(pairs)
            columns = [[h for h, _ in pairs], [p for _, p in pairs], [r for r, _ in judged], [v or default for _, v in judged]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.string()) for x in columns]], ["page_id", "host", "path", "rule", "verdict"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, host string, path string, rule string, verdict string"
    return pages.select("page_id", F.col("url").cast("string")).mapInArrow(run, schema)


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same for lists of any size; only the distinct (host, path) pairs are probed."""
    url = F.col("url").cast("string")
    host = F.translate(F.regexp_extract(url, SPLIT.pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.regexp_extract(url, SPLIT.pattern, 2), F.lit("")).alias("path"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = rules.select(F.length("path").alias("n")).distinct().agg(F.collect_set("n").alias("lengths"))
    pairs = split.select("host", "path").distinct().join(F.broadcast(lengths))  # one row
    tries = pairs.select("host", "path", F.explode(parents).alias("rule_host"), "lengths")
    tries = tries.select("host", "path", "rule_host", F.explode("lengths").alias("n")).filter("n <= length(path) and host <> ''")
    tries = tries.withColumn("rule_path", F.expr("substring(path, 1, n)"))
    known = rules.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("verdict"))
    met = tries.join(known, ["rule_host", "rule_path"])
    size = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), size).alias("best"))
    judged = split.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
