"""Hashes of landed files and hash trees over folders of them.

A file has the SHA-256 of its bytes. The files of a folder form a tree by the hash of their name: a node has the hash of
its children, and its name is the first digits of theirs, so a tree of `levels` has up to 16**levels lowest nodes whatever
the names look like. The root changes with any byte, name, missing or added file, and not with the order in which files
are listed. Two trees are compared from the root down; only nodes that differ are followed.

An empty folder has no root. Spark's readers pass over files without a byte, so these count as missing. Names must be unique within a folder. Files are read whole, one at a time per task, so a
file is limited to 2 GB by Spark's reader; larger tables are landed in parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 2


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of every file below `path`; folders named key=value become columns."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).option("pathGlobFilter", pattern).load(path)
    folders = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    return files.select(*folders, "path", "length", F.sha2("content", 256).alias("sha256"))


def hash_tree(files: DataFrame, by: list[str], name: str = "name", levels: int = LEVELS) -> DataFrame:
    """(by..., node, hash, n_files) of every node of the tree of each folder; the root is the node ''."""
    key = F.sha2(F.col(name).cast("string"), 256)
    leaf = F.sha2(F.concat_ws(":", key, "sha256"), 256)
    now = files.select(*by, key.alias("node"), leaf.alias("hash"), F.lit(1).cast("bigint").alias("n_files"))
    nodes = None
    for level in range(levels, -1, -1):
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))
        now = (
            now.groupBy(*by, F.substring("node", 1, level).alias("up"))
            .agg(children.alias("children"), F.sum("n_files").alias("n_files"))
            .select(
                *by, F.col("up").alias("node"),
                F.sha2(F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["node"], c["hash"])), ","), 256).alias("hash"),
                "n_files",
            )
        )
        nodes = now if nodes is None else nodes.unionByName(now)
    return nodes


def roots(files: DataFrame, by: list[str], name: str = "name", levels: int = LEVELS) -> DataFrame:
    """(by..., root, n_files)."""
    return hash_tree(files, by, name, levels).filter("node = ''").select(*by, F.col("hash").alias("root"), "n_files")


def changed_files(recorded: DataFrame, actual: DataFrame, by: list[str], name: str = "name", levels: int = LEVELS) -> DataFrame:
    """(by..., name, change) of files that were changed, added or removed, found through the lowest nodes that differ."""
    old, new = (hash_tree(f, by, name, levels).filter(F.length("node") == levels) for f in (recorded, actual))
    pairs = old.select(*by, "node", F.col("hash").alias("old")).join(new.select(*by, "node", F.col("hash").alias("new")), [*by, "node"], "full_outer")
    differ = pairs.filter(~F.col("old").eqNullSafe(F.col("new"))).select(*by, "node")

    def below(files: DataFrame, out: str) -> DataFrame:
        at = files.select(*by, name, F.col("sha256").alias(out), F.substring(F.sha2(F.col(name).cast("string"), 256), 1, levels).alias("node"))
        return at.join(differ, [*by, "node"], "left_semi").drop("node")

    both = below(recorded, "old").join(below(actual, "new"), [*by, name], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select(*by, name, change.alias("change")).filter("change is not null")
