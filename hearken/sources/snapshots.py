"""Published tables as snapshots behind one pointer.

A Python data source writes them in two phases. Every task writes its rows to a file of its own name in the folder of the new
snapshot and tells the driver about it; only when all tasks are done does `commit` write a pointer that lists the files that
count. The pointer is put in place by one move, so a reader sees the old snapshot or the new one, never a mixture, and files
of repeated or failed attempts are never listed. `abort` removes what a failed job left. A step that was skipped or has failed
for good is withdrawn: its pointer then names no files, and readers find an empty table instead of yesterday's rows.

Files go through pyarrow's file systems, so the path can be any URI that these open on the executors and that Spark reads.
Publishing needs no lock; of two publishers at once the later pointer counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "hearken_snapshot"
POINTER = "current.json"
POINTER_SCHEMA = "snapshot string, run_id string, files array<string>, n_rows bigint, withdrawn string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def point(path: str, pointer: dict) -> None:
    """Puts a pointer in place by one move."""
    store, base = opened(path)
    store.create_dir(base, recursive=True)
    draft = f"{base}/.{uuid.uuid4().hex}.json"
    with store.open_output_stream(draft) as out:
        out.write(json.dumps(pointer).encode())
    store.move(draft, f"{base}/{POINTER}")


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    n_rows: int


class SnapshotWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run_id: str):
        self.path, self.run_id, self.snapshot = path, run_id, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = opened(self.path)
        name, n_rows, out = f"{self.snapshot}/{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if out is None:
                    store.create_dir(f"{base}/{self.snapshot}", recursive=True)
                    out = pq.ParquetWriter(f"{base}/{name}", batch.schema, filesystem=store)
                out.write_batch(batch)
                n_rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, n_rows)

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        files = sorted(m.name for m in told if m.name)
        point(self.path, {"snapshot": self.snapshot, "run_id": self.run_id, "files": files, "n_rows": sum(m.n_rows for m in told)})

    def abort(self, messages: list[Written | None]) -> None:
        store, base = opened(self.path)
        if store.get_file_info(f"{base}/{self.snapshot}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.snapshot}")


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> SnapshotWriter:
        return SnapshotWriter(self.options["path"], self.options.get("run_id", ""))


def publish(df: DataFrame, path: str, run_id: str) -> None:
    """`df` becomes the table at `path` when all of it is written, and not before."""
    df.sparkSession.dataSource.register(SnapshotSource)
    df.write.format(FORMAT).option("run_id", run_id).mode("append").save(path)


def withdraw(path: str, run_id: str, reason: str) -> None:
    """From now on the table at `path` has no rows, and its pointer says why."""
    point(path, {"snapshot": None, "run_id": run_id, "files": [], "n_rows": 0, "withdrawn": reason})


def publish_step(step, path: str, run_id: str) -> str:
    """Runs `step`, a function that returns a table or None if there is nothing to do, and says what became of it.

    An output that this run did not make is withdrawn, so that no later step reads it as this run's.
    """
    try:
        made = step()
        if made is None:
            withdraw(path, run_id, "skipped")
            return "skipped"
        publish(made, path, run_id)
    except Exception:
        withdraw(path, run_id, "failed")
        raise
    return "published"


def pointer(spark: SparkSession, path: str) -> DataFrame:
    """The pointer as one row."""
    return spark.read.schema(POINTER_SCHEMA).json(f"{path.rstrip('/')}/{POINTER}")


def current(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of the current snapshot; none where it was withdrawn."""
    told = pointer(spark, path).first()
    if not told["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{name}" for name in told["files"]])


def remove_old(path: str) -> int:
    """Deletes the folders of snapshots that the pointer does not name, and says how many; run it when no reader is left on them."""
    store, base = opened(path)
    with store.open_input_stream(f"{base}/{POINTER}") as source:
        kept = json.loads(source.read())["snapshot"]
    old = [i for i in store.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory and i.base_name != kept]
    for info in old:
        store.delete_dir(info.path)
    return len(old)


def observed(df: DataFrame, path: str, run_id: str, metrics: dict[str, Column]) -> dict:
    """Publishes `df` and gives back aggregates (name -> expression) of its rows, from the very pass that writes them."""
    seen = Observation(f"published-{uuid.uuid4().hex}")
    publish(df.observe(seen, *[expr.alias(name) for name, expr in metrics.items()]), path, run_id)
    return seen.get


def counts(column: str, values: list) -> Column:
    """Aggregate: `value:n` of the listed values, of NULL (`none`) and of all others (`other`), as far as they occur."""
    cell = F.col(column)
    told = {str(v): F.count_if(cell == v) for v in values}
    told |= {"none": F.count_if(cell.isNull()), "other": F.count_if(~cell.isin(values))}
    return F.concat_ws(",", *[F.when(n > 0, F.concat_ws(":", F.lit(v), n.cast("string"))) for v, n in told.items()])
