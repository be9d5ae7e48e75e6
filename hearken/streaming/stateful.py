"""Streaming forms of the command operators.

Each of them keeps the state of one key only, and gives over a finished stream the rows that its
batch form gives over the same events. Events of a key must reach the stream in event order from
file to file; inside a batch they are sorted here.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hearken.functions.fixed_values import COMMAND_BUDGET, MAX_FRAMES

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE_STATE = "device bigint, capability string, at bigint, seq bigint, old int, new int"
CHANGE = Row("device", "capability", "at", "seq", "old", "new")
REPLAY_SCHEMA = "device bigint, seq bigint, outcome string"
FRAME_SCHEMA = "msg_id bigint, n_frames bigint, outcome string, message string"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """The rows one key has in this batch, sorted; a trigger bounds how many that are."""
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class Expiring(StatefulProcessor):
    """A processor that drops the state of a key when the watermark has passed its last event by `keep_ms`.

    Each batch of a key moves its one timer on. Without `keep_ms` there are no timers and states stay.
    """

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def started(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at bigint") if self.keep_ms is not None else None

    def move_timer(self, batch: pd.DataFrame) -> None:
        if self.due is not None:
            self.move_timer_to(int(batch["ts"].max().timestamp() * 1_000_000))

    def move_timer_to(self, last_micros: int | None) -> None:
        if self.due is None or last_micros is None:
            return
        at = last_micros // 1000 + self.keep_ms
        if self.due.exists():
            before = self.due.get()[0]
            if before >= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def forget(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.forget()
        self.due.clear()
        yield from ()

    def close(self) -> None:
        pass


def keyed(stream: DataFrame, keys: list[str], processor: Expiring, schema: str, delay: str) -> DataFrame:
    """The stream through the processor; event time only if states expire."""
    timed = stream if processor.keep_ms is None else stream.withWatermark("ts", delay)
    mode = "none" if processor.keep_ms is None else "eventTime"
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, outputMode="append", timeMode=mode)


class KeepChanges(Expiring):
    """Remembers the last value of a device capability and lets only changes through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.started(handle)
        self.current = handle.getValueState("current", "value int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # most keys have few rows, so they stay plain rows: a data frame for each key would cost more than the work
        batch = sorted(rows, key=lambda r: (r["at"] is None, r["at"], r["seq"] is None, r["seq"]))
        known = self.current.get()
        old = known[0] if known else None
        out = []
        for row in batch:
            if old is None or row["value"] != old:
                out.append(CHANGE(row["device"], row["capability"], row["at"], row["seq"], old, row["value"]))
            old = row["value"]
        if known is None or known[0] != old:
            self.current.update((old,))
        self.move_timer_to(max((r["at"] for r in batch if r["at"] is not None), default=None))
        yield from out

    def forget(self) -> None:
        self.current.clear()


def change_events(commands: DataFrame, keep_ms: int | None = None, delay: str = "1 minute") -> DataFrame:
    """Change events of a command stream, keyed by device and capability.

    The finer key keeps one busy device on several tasks; numbering per device is left to readers. With `keep_ms`, a
    capability that is silent for longer (in event time, past the watermark) is forgotten: its next command counts as its
    first, and commands later than the watermark are dropped.
    """
    # instants cross to Python as whole microseconds, which have no time zone
    timed = commands if keep_ms is None else commands.withWatermark("ts", delay)
    grouped = timed.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).groupBy("device", "capability")
    changes = grouped.transformWithState(
        KeepChanges(keep_ms), CHANGE_STATE, outputMode="append", timeMode="none" if keep_ms is None else "eventTime"
    )
    return changes.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "ts")


def challenge_outcomes(issue: np.ndarray, nonce: np.ndarray, live: str | None, is_open: bool) -> tuple[np.ndarray, str | None, bool]:
    """Outcomes of the rows that are no issues, in order, and the challenge after them.

    Runs begin at issues; the first attempt of a run that has its nonce closes it, and all others after that find none.
    """
    given = ~pd.isna(nonce)
    run = np.cumsum(issue)
    heads = np.flatnonzero(issue)
    wanted = np.append(np.array([live if is_open else None], object), np.where(given[heads], nonce[heads], None))[run]
    opened = np.append(is_open, np.ones(len(heads), bool))[run]
    match = ~issue & given & opened & (nonce == wanted) & ~pd.isna(wanted)
    used = np.cumsum(match) - match
    used = used - np.append(0, used[heads])[run]
    outcome = np.where(match, "accepted", np.where(given, "mismatch", "malformed"))
    outcome = np.where(~opened | (used > 0), "no_challenge", outcome)
    if len(heads):
        live, is_open = (nonce[heads[-1]] if given[heads[-1]] else None), True
    return outcome[~issue], live, bool(is_open and not match[run == len(heads)].any())


class GuardChallenges(Expiring):
    """Holds the one live challenge of a device; a matching attempt closes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.started(handle)
        self.live = handle.getValueState("live", "nonce string, open boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        nonce, is_open = self.live.get() if self.live.exists() else (None, False)
        batch = in_order(rows, ["ts", "seq"])
        issue = (batch["kind"] == "issue").to_numpy()
        outcome, nonce, is_open = challenge_outcomes(issue, batch["nonce"].to_numpy(object), nonce, bool(is_open))
        self.live.update((nonce, is_open))
        self.move_timer(batch)
        attempts = batch[~issue]
        yield pd.DataFrame({"device": attempts["device"], "seq": attempts["seq"], "outcome": outcome})

    def forget(self) -> None:
        self.live.clear()


def replay_guard(events: DataFrame, keep_ms: int | None = None, delay: str = "1 minute") -> DataFrame:
    """Outcomes of attempts; with `keep_ms`, a challenge whose device is silent for longer is forgotten, which closes it."""
    return keyed(events, ["device"], GuardChallenges(keep_ms), REPLAY_SCHEMA, delay)


def frame_reason(seq_no: pd.Series, total: pd.Series, n: int, known_total: int | None, known: list[int]) -> tuple[int, str | None]:
    """How many frames come before the first that breaks a rule, and which rule that is; `n` frames were there before."""
    totals, seqs = total.to_numpy(float, na_value=np.nan), seq_no.to_numpy(float, na_value=np.nan)
    expected = float(known_total) if known_total is not None else totals[0]
    rules = {
        "total_invalid": ~(totals >= 1),
        "totals_differ": totals != expected,
        "too_many_frames": (totals > MAX_FRAMES) | (n + 1 + np.arange(len(totals)) > MAX_FRAMES),
        "seq_out_of_range": ~((seqs >= 0) & (seqs < totals)),
        "seq_repeated": pd.Series(seqs).duplicated().to_numpy() | np.isin(seqs, known),
    }
    broken = np.stack(list(rules.values()))
    at = np.flatnonzero(broken.any(axis=0))
    return (int(at[0]), list(rules)[int(broken[:, at[0]].argmax())]) if len(at) else (len(totals), None)


class CollectFrames(StatefulProcessor):
    """Gathers the frames of a message; emits it when the announced number has arrived.

    The buffer never holds more than MAX_FRAMES frames: a message that breaks a rule is rejected on
    the spot and its buffer dropped. A message that is still incomplete when the watermark has
    passed its first frame by `wait_ms` is rejected then.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "seq_no int", "payload string")
        self.seen = handle.getValueState("seen", "n bigint, total int, outcome string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, total, outcome = self.seen.get() if self.seen.exists() else (0, None, None)
        batch = in_order(rows, ["seq_no"])
        if n == 0:
            self.handle.registerTimer(int(batch["ts"].min().timestamp() * 1000) + self.wait_ms)
        if outcome is None:
            first = batch.head(MAX_FRAMES + 1)  # more frames break a rule whatever they hold
            known = [k[0] for k, _ in self.frames.iterator()]
            good, outcome = frame_reason(first["seq_no"], first["total"], n, total, known)
            n += good + (outcome is not None)
            for seq_no, payload in zip(first["seq_no"].head(good).tolist(), first["payload"].head(good).tolist()):
                self.frames.updateValue((int(seq_no),), (payload,))
            total = int(first["total"].iloc[0]) if total is None and good else total
            message = None
            if outcome is None and n == total:
                parts = sorted((k[0], v[0]) for k, v in self.frames.iterator())
                text = "".join(p for _, p in parts)
                outcome = "too_large" if len(text.encode()) > COMMAND_BUDGET else "complete"
                message = text if outcome == "complete" else None
            self.seen.update((n, total, outcome))
            if outcome:
                self.frames.clear()
                yield self.row(key, n, outcome, message)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, _total, outcome = self.seen.get()
        self.frames.clear()
        self.seen.clear()
        if outcome is None:
            yield self.row(key, n, "total_not_received", None)

    @staticmethod
    def row(key: Any, n: int, outcome: str, message: str | None) -> pd.DataFrame:
        return pd.DataFrame(
            {"msg_id": [key[0]], "n_frames": [n], "outcome": [outcome], "message": [message]}
        )

    def close(self) -> None:
        pass


def reassemble(frames: DataFrame, delay: str = "1 minute", wait_ms: int = 60_000) -> DataFrame:
    """Messages from a stream of frames that carry their arrival time in `ts`."""
    timed = frames.withWatermark("ts", delay)
    return timed.groupBy("msg_id").transformWithStateInPandas(
        CollectFrames(wait_ms), FRAME_SCHEMA, outputMode="append", timeMode="eventTime"
    )


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream over everything that has landed, then stop; a rerun goes on from there."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def landed(spark: SparkSession, path: str, schema: Any, files_per_batch: int = 1000) -> DataFrame:
    """A stream over landed parquet files. The checkpoint of the query that drains it records the
    files already read, so an interrupted ingest resumes without reading any of them twice."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def deduplicated(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First arrival per key within the watermark."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
