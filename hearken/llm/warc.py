"""WARC archives with a two-level capture index.

`write` puts one record per page into gzip members of WARC 1.1 files in the shared folder, one file per task. Records with
equal payloads (SHA-1 and length) of at least `min_bytes` bytes are stored once: the smallest page_id is a `response`,
the others are `revisit` records that refer to it. A record's identity is its page_id with a hash of url and payload, so
rows that share a page_id are captures of their own.

`build_index` sorts captures by (reversed-host URL key, identity) into ranges, one index file each. A file holds compressed
blocks of `BLOCK_LINES` captures; beside it stands its sparse block directory (first key and byte range of every block).
`find` sends each request to its file (binary search in the list of first keys, one entry per index file), there to its
block (binary search in the directory of that file), reads that byte range and finds the capture in it by binary search.
`read_records` then reads the byte ranges of the records, neighbouring ranges at once.

Nothing that grows with the pages is broadcast: only the first key of each index file. The requests are sorted, so a task
holds one directory and one block at a time. Files of failed task attempts are never in the index.

Defined results: a null html is an empty payload; a null url has the key "" and no target header. A page_id may be of any
type that has text, and may be null or repeated: every row has its result. Rows that share the smallest page_id of a
payload are responses; a null page_id revisits if any row with the same payload has one, and is a response otherwise. Rows
equal in all three columns have a record each and are read back from the first of them. Control characters in urls are
percent-encoded in the header. Further columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.batches import small_batches
from hearken.session import materialize, scratch_dir

BLOCK_LINES = 1000
SLICE = 32 << 20  # bytes of archive that a task reads, about
READ_BYTES = 4 << 20  # neighbouring records are read together up to this size
DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, then `)` and the rest of the url: `org,example)/a?b`."""
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^[^:/?#]*://[^/?#]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.when(url.isNull(), "").when(host == "", url).otherwise(key)


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def record(ident: str, url: str | None, payload: bytes, sha1: bytes, first: str | None) -> bytes:
    """One record as a gzip member; `first` is the page a revisit refers to."""
    digest = base64.b32encode(sha1).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{quoted(ident)}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{quoted(first)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return gzip_member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def quoted(text: str) -> str:
    """Text as it may stand in a header between angle brackets."""
    return re.sub(r"[\x00-\x20\x7f<>%]", lambda m: f"%{ord(m[0]):02X}", text)


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (both with lower-case names) and payload of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = headers(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, headers(http), payload


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def identity() -> Column:
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return F.concat(page, F.lit(":"), F.substring(F.sha2(F.concat_ws(":", F.hex("sha1"), F.col("url")), 256), 1, 16))


def with_first(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, id, url, payload, sha1, first): `first`, the page a revisit refers to, is null for responses."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    wide = pages.select("page_id", "url", payload.alias("payload"))
    wide = wide.withColumns({"sha1": F.unhex(F.sha1("payload")), "size": F.length("payload")})
    firsts = wide.filter(f"size >= {min_bytes} and page_id is not null").groupBy("sha1", "size").agg(F.min("page_id").alias("first"))
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return wide.join(firsts, ["sha1", "size"], "left").select(
        "page_id", identity().alias("id"), "url", "payload", "sha1", F.when(revisits, F.col("first").cast("string")).alias("first")
    )


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives; returns captures (key, id, file, at, size, page_id)."""
    schema = f"{CAPTURE_SCHEMA}, page_id {pages.schema['page_id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_folder(folder)
        task = TaskContext.get()
        file = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for batch in batches:
            rows = []
            for key, ident, url, payload, sha1, first in zip(*[c.to_pylist() for c in batch.columns[:6]]):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{file}", compression=None)
                    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{file}>\r\nWARC-Date: {DATE}\r\nContent-Length: 0\r\n\r\n"
                    at = out.write(gzip_member(info.encode() + b"\r\n\r\n"))
                member = record(ident, url, payload, sha1, first)
                rows.append((key, ident, file, at, len(member)))
                at += out.write(member)
            yield pa.RecordBatch.from_arrays([*captured(rows), batch.column(6)], [*CAPTURE, "page_id"])
        if out is not None:
            out.close()

    ready = with_first(small_batches(pages), min_bytes).select(url_key(F.col("url")).alias("key"), "id", "url", "payload", "sha1", "first", "page_id")
    return materialize(ready.mapInArrow(run, schema), "captures")


CAPTURE = ["key", "id", "file", "at", "size"]
CAPTURE_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
CAPTURE_SCHEMA = "key string, id string, file string, at bigint, size bigint"


def captured(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(x, t) for x, t in zip(zip(*rows), CAPTURE_TYPES)] if rows else [pa.array([], t) for t in CAPTURE_TYPES]


def sort_key(key: str, ident: str) -> tuple[bytes, bytes]:
    """As Spark orders strings: by their bytes."""
    return key.encode(), ident.encode()


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the index; returns its files (file, key, id: the first capture; captures: their number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_folder(folder)
        task = TaskContext.get()
        file = f"index-{task.partitionId():05d}-{task.taskAttemptId()}"
        out, at, held, directory, total = None, 0, [], [], 0

        def flush() -> None:
            nonlocal at, held
            block = zlib.compress("\n".join("\t".join(x) for x in held).encode(), 5)
            directory.append("\t".join([held[0][0], held[0][1], str(at), str(len(block))]))
            at += out.write(block)
            held = []

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{file}", compression=None)
                held.append((escaped(row[0]), escaped(row[1]), *map(str, row[2:])))
                total += 1
                if len(held) == BLOCK_LINES:
                    flush()
        if out is None:
            return
        if held:
            flush()
        out.close()
        with store.open_output_stream(f"{top}/{file}.dir", compression=None) as side:
            side.write("\n".join(directory).encode())
        key, ident = map(unescaped, directory[0].split("\t")[:2])
        yield pa.RecordBatch.from_pydict({"file": [file], "key": [key], "id": [ident], "captures": [total]})

    ranged = captures.select(*CAPTURE).repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    return materialize(ranged.mapInArrow(run, "file string, key string, id string, captures bigint"), "index")


def escaped(key: str) -> str:
    """Percent signs and control characters encoded, so that a capture is one line of tab-separated fields."""
    return re.sub(r"[\x00-\x1f%]", lambda m: f"%{ord(m[0]):02X}", key)


def unescaped(key: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), key)


def find(requests: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """The captures (key, id, file, at, size) of requests (key, id), once each; unknown ones give no row."""
    files = sorted((sort_key(r["key"], r["id"]), r["file"]) for r in index.select("key", "id", "file").toLocalIterator())
    starts, names = [x for x, _ in files], [x for _, x in files]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = [bisect_right(starts, sort_key(*x)) - 1 for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spots, pa.int64())], ["key", "id", "spot"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_folder(folder)
        spot, block_no, source = -1, -1, None
        firsts, ranges, keys, lines = [], [], [], []
        for batch in batches:
            found = []
            for key, ident, wanted in zip(*[c.to_pylist() for c in batch.columns]):
                if wanted != spot:
                    spot, block_no = wanted, -1
                    source = store.open_input_file(f"{top}/{names[spot]}")
                    with store.open_input_stream(f"{top}/{names[spot]}.dir", compression=None) as side:
                        entries = [x.split("\t") for x in side.read().decode().split("\n")]
                    firsts = [sort_key(unescaped(k), unescaped(p)) for k, p, _, _ in entries]
                    ranges = [(int(a), int(n)) for _, _, a, n in entries]
                target = sort_key(key, ident)
                block = bisect_right(firsts, target) - 1
                if block != block_no:
                    block_no = block
                    start, size = ranges[block]
                    lines = [x.split("\t") for x in zlib.decompress(source.read_at(size, start)).decode().split("\n")]
                    keys = [sort_key(unescaped(x[0]), unescaped(x[1])) for x in lines]
                at = bisect_left(keys, target)
                if at < len(keys) and keys[at] == target:
                    _, _, file, offset, size = lines[at]
                    found.append((key, ident, file, int(offset), int(size)))
            yield pa.RecordBatch.from_arrays(captured(found), CAPTURE)

    wanted = requests.select("key", "id").distinct()
    placed = wanted.mapInArrow(place, "key string, id string, spot bigint").filter("spot >= 0")
    return placed.repartition(max(1, len(names)), "spot").sortWithinPartitions("spot", "key", "id").mapInArrow(look, CAPTURE_SCHEMA)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """(id, record_type, refers_to, payload, payload_digest) by range reads, a task for about every SLICE bytes.

    A revisit's payload is null.
    """

    def read(store: pafs.FileSystem, top: str, rows: list[tuple]) -> Iterator[tuple]:
        start = rows[0][2]
        with store.open_input_file(f"{top}/{rows[0][1]}") as source:
            data = source.read_at(rows[-1][2] + rows[-1][3] - start, start)
        for ident, _, at, size in rows:
            warc, _, payload = parse(data[at - start : at - start + size])
            revisit = warc["warc-type"] == "revisit"
            digest = warc["warc-payload-digest"].removeprefix("sha1:")
            if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"record {ident} is damaged")
            refers = unescaped(warc["warc-refers-to"].removeprefix("<urn:page:").rstrip(">")) if revisit else None
            yield ident, warc["warc-type"], refers, None if revisit else payload, digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_folder(folder)
        types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
        names = ["id", "record_type", "refers_to", "payload", "payload_digest"]
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns]))
            while rows:
                count, end = 1, rows[0][2] + rows[0][3]
                while count < len(rows) and rows[count][1:3] == (rows[0][1], end) and end - rows[0][2] < READ_BYTES:
                    end += rows[count][3]
                    count += 1
                done = zip(*read(store, top, rows[:count]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(done, types)], names=names)
                rows = rows[count:]

    total = captures.agg(F.sum("size")).first()[0] or 0
    picked = captures.select("id", "file", "at", "size").withColumn("slice", F.floor(F.col("at") / SLICE))
    sorted_rows = picked.repartition(2 * total // SLICE + 1, "file", "slice").sortWithinPartitions("file", "at").drop("slice")
    return sorted_rows.mapInArrow(run, "id string, record_type string, refers_to string, payload binary, payload_digest string")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive all pages, then look each up in the index and read its record back."""
    spark = pages.sparkSession
    archive, index_folder = scratch_dir(spark, "warc"), scratch_dir(spark, "cdx")
    captures = write(pages, archive, min_bytes)
    index = build_index(captures, index_folder)
    requests = materialize(find(captures, index, index_folder), "found")
    records = read_records(requests, archive)
    narrow = records.select("id", F.length("payload").cast("bigint").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    narrow = materialize(captures.select("id", "page_id").join(narrow, "id"), "records")
    # a payload has one length, so a revisit takes that of any response with its digest
    stored = narrow.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("_of_first"))
    resolved = narrow.join(stored, "payload_digest", "left")
    kind = pages.schema["page_id"].dataType
    return resolved.select(
        "page_id", F.coalesce("payload_bytes", "_of_first").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
