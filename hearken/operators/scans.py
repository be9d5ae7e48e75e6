"""Prefix scans over event tables: work in order on keys of any size.

The rows are range-partitioned once by (device, ts, seq), so a part has about as many rows as any other and a busy device
takes up several parts. Every part is read in order by one task, which settles all it can see: only what depends on
rows before the part stays open, and that concerns the part's first device alone. Next to its rows a part leaves one
carry: what it does to the state of its last device. The carries, one a part, are folded in one small task, and the
incoming states are broadcast to the written rows, which are settled where they lie. So the rows are shuffled once.

The task keeps the state of one device only; record batches are worked on as arrays.

Rows that share device, ts and seq are in no defined order. Devices may be NULL and are one device then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.session import materialize

ORDER = ["device", "ts", "seq"]
Settle = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def scanned(rows: DataFrame, settle: Settle, schema: str, parts: int | None, purpose: str) -> DataFrame:
    """The output of `settle` over ranges of `rows`, written."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    return materialize(placed.mapInArrow(settle, schema), purpose)


def folded(carries: DataFrame, fold: Settle, schema: str) -> DataFrame:
    """`fold` over the carries in the order of the parts; there is one row a part."""
    return carries.repartition(1).sortWithinPartitions("part").mapInArrow(fold, schema)


def numbers(column: pa.Array) -> tuple[np.ndarray, list[Any]]:
    """Codes of the values, NULL among them, and the values."""
    found = pc.dictionary_encode(column, null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def by_type(rows: DataFrame, **names: str) -> dict[str, str]:
    return {out: rows.schema[name].dataType.simpleString() for out, name in names.items()}


class Running:
    """Where a part stands: its first device, the device it has come to, and how many rows it has read."""

    def __init__(self) -> None:
        self.started, self.first, self.device, self.rows = False, None, None, 0

    def enter(self, devices: list[Any]) -> None:
        if not self.started:
            self.started, self.first, self.device = True, devices[0], devices[0]


# --- change events -------------------------------------------------------------------------------


def change_events(commands: DataFrame, parts: int | None = None) -> DataFrame:
    """(device, change_no, ts, seq, capability, old, new); values must not be NULL."""
    kinds = by_type(commands, device="device", capability="capability", value="value", ts="ts", seq="seq")
    pair = f"capability {kinds['capability']}, value {kinds['value']}"
    carry = "carry struct<" + (
        f"first:{kinds['device']},last:{kinds['device']},n_first:bigint,n_last:bigint,"
        f"opens:array<struct<capability:{kinds['capability']},value:{kinds['value']},pos:bigint>>,"
        f"values:array<struct<capability:{kinds['capability']},value:{kinds['value']}>>>"
    )
    schema = f"device {kinds['device']}, ts {kinds['ts']}, seq {kinds['seq']}, {pair}, old {kinds['value']}, open boolean, no bigint, pos bigint, part int, {carry}"
    incoming = (
        f"part int, first {kinds['device']}, n_before bigint, "
        f"opens array<struct<capability:{kinds['capability']},pos:bigint,old:{kinds['value']},changed:boolean>>"
    )
    picked = commands.select("device", "ts", "seq", "capability", "value")
    written = scanned(picked, settle_changes, schema, parts, "changes")
    states = folded(written.filter("carry is not null").select("part", "carry"), fold_changes, incoming)
    # one row a part
    joined = written.filter("carry is null").drop("carry").join(F.broadcast(states), "part", "left")
    mine = F.get(F.filter("opens", lambda o: o["capability"].eqNullSafe(F.col("capability"))), F.lit(0))["old"]
    settled = joined.withColumn("old", F.when(F.col("open"), mine).otherwise(F.col("old")))
    changed = settled.filter(F.col("old").isNull() | (F.col("old") != F.col("value")))
    before = F.size(F.filter("opens", lambda o: o["changed"] & (o["pos"] <= F.col("pos"))))
    number = F.col("no") + F.when(F.col("device").eqNullSafe(F.col("first")), F.col("n_before") + before).otherwise(0)
    return changed.select("device", number.cast("bigint").alias("change_no"), "ts", "seq", "capability", "old", F.col("value").alias("new"))


def settle_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their old value, or open where it lies before the part, and their number among the part's changes."""
    at, part = Running(), TaskContext.get().partitionId()
    known: dict[Any, Any] = {}  # values of the device it has come to
    opens: list[dict[str, Any]] = []
    count = n_first = 0
    types: pa.Schema | None = None
    for batch in batches:
        types = batch.schema
        if not batch.num_rows:
            continue
        n, values = batch.num_rows, batch.column(4)
        device, devices = numbers(batch.column(0))
        capability, names = numbers(batch.column(3))
        at.enter([devices[device[0]]])
        key = device * len(names) + capability
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        previous = np.full(n, -1)
        previous[order[1:][same]] = order[:-1][same]
        old = values.take(pa.array(previous, mask=previous < 0))
        is_open, patch, told = np.zeros(n, bool), np.zeros(n, bool), []
        for i in np.flatnonzero(previous < 0).tolist():  # once for each device and capability
            name, owner = names[capability[i]], devices[device[i]]
            if owner == at.device and name in known:
                patch[i] = True
                told.append(known[name])
            elif owner == at.first:
                is_open[i] = True
                opens.append({"capability": name, "value": values[i].as_py(), "pos": at.rows + i})
        old = pc.replace_with_mask(old, pa.array(patch), pa.array(told, values.type))
        changed = pc.fill_null(pc.not_equal(old, values), True).to_numpy(zero_copy_only=False) & ~is_open
        sums = np.cumsum(changed)
        starts = np.flatnonzero(np.r_[True, device[1:] != device[:-1]])
        base = np.repeat((sums - changed)[starts], np.diff(np.r_[starts, n]))
        no = sums - base + np.where(device == device[0], count if devices[device[0]] == at.device else 0, 0)
        last = devices[device[-1]]
        if last != at.device:
            known = {}
        ends = np.r_[np.flatnonzero(~same), n - 1]
        for i in order[ends].tolist():
            if devices[device[i]] == last:
                known[names[capability[i]]] = values[i].as_py()
        if devices[device[0]] == at.first:
            n_first = int(no[np.flatnonzero(device == device[0])[-1]])
        count, at.device = int(no[-1]), last
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns, old, pa.array(is_open), pa.array(no), pa.array(np.arange(at.rows, at.rows + n)),
                pa.array(np.full(n, part, np.int32)), pa.nulls(n, carry_type(types)),
            ],
            [*types.names, *CHANGE_COLUMNS],
        )
        at.rows += n
    if at.started:
        carry = {
            "first": at.first, "last": at.device, "n_first": n_first, "n_last": count, "opens": opens,
            "values": [{"capability": k, "value": v} for k, v in known.items()],
        }
        empty = [pa.nulls(1, t) for t in (*types.types, types.field(4).type, pa.bool_(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [*empty, pa.array([part], pa.int32()), pa.array([carry], carry_type(types))], [*types.names, *CHANGE_COLUMNS]
        )


CHANGE_COLUMNS = ["old", "open", "no", "pos", "part", "carry"]


def carry_type(types: pa.Schema) -> pa.DataType:
    device, name, value = (types.field(i).type for i in (0, 3, 4))
    pair = [("capability", name), ("value", value)]
    return pa.struct([
        ("first", device), ("last", device), ("n_first", pa.int64()), ("n_last", pa.int64()),
        ("opens", pa.list_(pa.struct([*pair, ("pos", pa.int64())]))), ("values", pa.list_(pa.struct(pair))),
    ])


def fold_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The count and the values that every part's first device comes with."""
    device, values, count, started = None, {}, 0, False
    for batch in batches:
        kind = batch.schema.field("carry").type
        first, pair = kind.field("first").type, kind.field("opens").type.value_type
        found = []
        for row in batch.to_pylist():
            carry = row["carry"]
            if not started or carry["first"] != device:
                values, count = {}, 0
            started = True
            opens = []
            for o in carry["opens"]:
                old = values.get(o["capability"])
                opens.append({"capability": o["capability"], "pos": o["pos"], "old": old, "changed": old is None or old != o["value"]})
            found.append({"part": row["part"], "first": carry["first"], "n_before": count, "opens": opens})
            given = {v["capability"]: v["value"] for v in carry["values"]}
            if carry["first"] == carry["last"]:
                values, count = {**values, **given}, count + carry["n_first"] + sum(o["changed"] for o in opens)
            else:
                values, count = given, carry["n_last"]
            device = carry["last"]
        opened = pa.struct([("capability", pair.field("capability").type), ("pos", pa.int64()), ("old", pair.field("value").type), ("changed", pa.bool_())])
        schema = pa.schema([("part", pa.int32()), ("first", first), ("n_before", pa.int64()), ("opens", pa.list_(opened))])
        yield pa.RecordBatch.from_pylist(found, schema)


# --- replay guard --------------------------------------------------------------------------------


def replay_guard(events: DataFrame, parts: int | None = None) -> DataFrame:
    """(device, seq, outcome) of every attempt."""
    kinds = by_type(events, device="device", ts="ts", seq="seq")
    state = f"first:{kinds['device']},last:{kinds['device']},has:boolean,nonce:string,used:boolean"
    schema = f"device {kinds['device']}, ts {kinds['ts']}, seq {kinds['seq']}, nonce string, outcome string, part int, carry struct<{state}>"
    picked = events.select("device", "ts", "seq", "kind", F.col("nonce").cast("string").alias("nonce"))
    written = scanned(picked, settle_attempts, schema, parts, "attempts")
    incoming = "part int, has boolean, live string, used boolean, chain int"
    states = materialize(folded(written.filter("carry is not null").select("part", "carry"), fold_challenges, incoming), "challenges")
    # of the attempts that wait for what their part came with, the first match in all parts that saw no issue
    waiting = written.filter("carry is null and outcome is null").join(F.broadcast(states.filter("has and not used")), "part")
    firsts = waiting.filter("nonce = live").groupBy("chain").agg(F.min(F.struct("ts", "seq")).alias("hit"))  # one row a part at most
    known = materialize(states.join(F.broadcast(firsts), "chain", "left"), "challenges")
    joined = written.filter("carry is null").drop("carry").join(F.broadcast(known), "part", "left")
    late = F.coalesce(F.struct("ts", "seq") > F.col("hit"), F.lit(False))
    late_outcome = (
        F.when(~F.col("has") | F.col("used") | late, "no_challenge")
        .when(F.col("nonce").isNull(), "malformed")
        .when(F.col("nonce") == F.col("live"), "accepted")
        .otherwise("mismatch")
    )
    return joined.select("device", "seq", F.coalesce("outcome", late_outcome).alias("outcome"))


def settle_attempts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Attempts with their outcome, or NULL where the challenge, if any, lies before the part."""
    at, part = Running(), TaskContext.get().partitionId()
    has, live, used = False, None, False
    types: pa.Schema | None = None
    names = ["device", "ts", "seq", "nonce", "outcome", "part", "carry"]
    for batch in batches:
        types = batch.schema
        if not batch.num_rows:
            continue
        n = batch.num_rows
        device, devices = numbers(batch.column(0))
        nonce, nonces = numbers(batch.column(4))
        null = nonces.index(None) if None in nonces else -1
        at.enter([devices[device[0]]])
        issue = pc.fill_null(pc.equal(batch.column(3), "issue"), False).to_numpy(zero_copy_only=False)
        attempt = pc.fill_null(pc.equal(batch.column(3), "attempt"), False).to_numpy(zero_copy_only=False)
        begins = np.r_[devices[device[0]] != at.device, device[1:] != device[:-1]] | issue
        # a run goes on under one challenge; run 0 is under that of the batch before
        run = np.cumsum(begins)
        heads = np.r_[0, np.flatnonzero(begins)]
        own = np.r_[has, issue[heads[1:]]]
        code = np.r_[nonces.index(live) if has and live is not None and live in nonces else -2, nonce[heads[1:]]]
        match = attempt & own[run] & (nonce == code[run]) & (nonce != null)
        sums = np.cumsum(match)
        before = sums - match - np.r_[0, (sums - match)[heads[1:]]][run] + np.where(run == 0, int(used), 0)
        answer = np.where(before > 0, 0, np.where(nonce == null, 1, np.where(match, 2, 3)))
        waits = ~own[run] & (np.array([d == at.first for d in devices])[device])
        outcomes = pa.array(["no_challenge", "malformed", "accepted", "mismatch", None])
        answer = np.where(own[run], answer, np.where(waits, 4, 0))
        some = pa.array(np.flatnonzero(attempt))
        last = run[-1]
        if last:
            has, used = bool(own[last]), False
            live = nonces[code[last]] if has else None
        used = used or bool(match[run == last].any())
        at.device = devices[device[-1]]
        told = outcomes.take(pa.array(answer))
        picked = [c.take(some) for c in (*batch.columns[:3], batch.column(4), told)]
        yield pa.RecordBatch.from_arrays([*picked, pa.array(np.full(len(some), part, np.int32)), pa.nulls(len(some), guard_type(types))], names)
    if at.started:
        carry = {"first": at.first, "last": at.device, "has": has, "nonce": live, "used": used}
        empty = [pa.nulls(1, t) for t in (*types.types[:3], types.field(4).type, pa.string())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array([part], pa.int32()), pa.array([carry], guard_type(types))], names)


def guard_type(types: pa.Schema) -> pa.DataType:
    device = types.field(0).type
    return pa.struct([("first", device), ("last", device), ("has", pa.bool_()), ("nonce", pa.string()), ("used", pa.bool_())])


def fold_challenges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The challenge that every part's first device comes with; `chain` is the part it was issued in."""
    device, has, live, used, chain, started = None, False, None, False, -1, False
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            carry = row["carry"]
            if not started or carry["first"] != device:
                has, live, used, chain = False, None, False, -1
            started = True
            found.append({"part": row["part"], "has": has, "live": live, "used": used, "chain": chain})
            if carry["has"] or carry["first"] != carry["last"]:
                has, live, used, chain = carry["has"], carry["nonce"], carry["used"], row["part"]
            device = carry["last"]
        schema = pa.schema([("part", pa.int32()), ("has", pa.bool_()), ("live", pa.string()), ("used", pa.bool_()), ("chain", pa.int32())])
        yield pa.RecordBatch.from_pylist(found, schema)
