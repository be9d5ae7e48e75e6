"""Stream forms: states expire, and the results are those of the batch forms."""

import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from hearken.operators import commands
from hearken.streaming import stateful

DAY = 86_400_000


def drained(spark, folder, batches, build):
    """Each batch lands as files of its own and is drained; returns (result, checkpoint)."""
    stateful.use_state_store(spark)
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = build(stateful.landed(spark, f"{folder}/in", batch.schema))
        stateful.drain(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), f"{folder}/checkpoint"


def kept(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).count()


def days(spark, data, schema):
    return spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_seconds(F.col("day") * 86400 + F.col("seq"))).drop("day")


def random_commands(spark, day, n=80, start=0):
    rng = random.Random(day)
    data = [(day, start + i, rng.randrange(6), rng.choice("ab"), rng.randrange(3)) for i in range(n)]
    return days(spark, data, "day bigint, seq bigint, device bigint, capability string, value int")


@pytest.mark.parametrize("keep", [None, 30 * DAY])
def test_changes_equal_the_batch_form(spark, tmp_path, keep):
    batches = [random_commands(spark, 10 + i, start=100 * i) for i in range(3)]
    found, _ = drained(spark, str(tmp_path), batches, lambda s: stateful.change_events(s, keep))
    every = batches[0].unionByName(batches[1]).unionByName(batches[2])
    assert rows(found, "device", "capability", "seq", "old", "new") == rows(commands.change_events(every), "device", "capability", "seq", "old", "new")


def test_silent_capabilities_are_forgotten(spark, tmp_path):
    first = random_commands(spark, 10)
    later = [days(spark, [(40 + i, 900 + i, 77, "z", i)], "day bigint, seq bigint, device bigint, capability string, value int") for i in range(3)]
    back = days(spark, [(43, 990, r["device"], r["capability"], 9) for r in first.select("device", "capability").distinct().limit(1).collect()], "day bigint, seq bigint, device bigint, capability string, value int")
    n = first.select("device", "capability").distinct().count()
    _, checkpoint = drained(spark, str(tmp_path / "one"), [first], lambda s: stateful.change_events(s, 5 * DAY))
    assert kept(spark, checkpoint, "current") == kept(spark, checkpoint, "due") == n
    found, checkpoint = drained(spark, str(tmp_path / "two"), [first, *later, back], lambda s: stateful.change_events(s, 5 * DAY))
    assert kept(spark, checkpoint, "current") == kept(spark, checkpoint, "due") == 2
    assert rows(found.filter("seq = 990"), "old", "new") == [(None, 9)]


def test_guard_equals_the_batch_form_and_forgets(spark, tmp_path):
    schema = "day bigint, seq bigint, device bigint, kind string, nonce string"
    rng = random.Random(5)

    def batch(day):
        data = [(day, 100 * day + i, rng.randrange(5), rng.choice(["issue", "attempt", "attempt"]), rng.choice(["x", "y", None])) for i in range(80)]
        return days(spark, data, schema)

    batches = [batch(d) for d in (3, 4, 5)]
    every = batches[0].unionByName(batches[1]).unionByName(batches[2])
    want = rows(commands.replay_guard(every), "device", "seq", "outcome")
    for keep in (None, 30 * DAY):
        found, checkpoint = drained(spark, str(tmp_path / str(keep)), batches, lambda s, keep=keep: stateful.replay_guard(s, keep))
        assert rows(found, "device", "seq", "outcome") == want
        assert kept(spark, checkpoint, "live") == 5
    silent = [days(spark, [(60 + i, 9000 + i, 99, "issue", "x")], schema) for i in range(3)]
    late = days(spark, [(63, 9990, 0, "attempt", "x")], schema)
    found, checkpoint = drained(spark, str(tmp_path / "silent"), [*batches, *silent, late], lambda s: stateful.replay_guard(s, 5 * DAY))
    assert kept(spark, checkpoint, "live") == 2
    assert rows(found.filter("seq = 9990"), "outcome") == [("no_challenge",)]


def test_vectorised_outcomes_equal_single_steps():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randrange(1, 12)
        kinds, nonces = [rng.random() < 0.3 for _ in range(n)], [rng.choice(["x", "y", None]) for _ in range(n)]
        live, is_open = rng.choice([(None, False), ("x", True), (None, True), ("x", False)])
        now, still, want = live, is_open, []
        for issue, nonce in zip(kinds, nonces):
            if issue:
                now, still = nonce, True
            elif not still:
                want.append("no_challenge")
            elif nonce is None:
                want.append("malformed")
            elif nonce == now:
                want.append("accepted")
                still = False
            else:
                want.append("mismatch")
        frame = pd.DataFrame({"issue": kinds, "nonce": pd.Series(nonces, dtype=object)})
        found, _, then = stateful.challenge_outcomes(frame["issue"].to_numpy(), frame["nonce"].to_numpy(object), live, is_open)
        assert found.tolist() == want and then == still


def test_frame_reasons_name_the_first_broken_rule():
    def reason(seqs, totals, n=0, total=None, known=()):
        return stateful.frame_reason(pd.Series(seqs, dtype="Int32"), pd.Series(totals, dtype="Int32"), n, total, list(known))

    assert reason([0, 1], [2, 2]) == (2, None)
    assert reason([0, 1], [2, None]) == (1, "total_invalid") and reason([0], [0]) == (0, "total_invalid")
    assert reason([0, 1], [2, 3]) == (1, "totals_differ") and reason([1], [3], 1, 2, [0]) == (0, "totals_differ")
    assert reason([0], [300]) == (0, "too_many_frames") and reason([0, 1], [2, 2], 255, 2) == (0, "too_many_frames")
    assert reason([2], [2]) == (0, "seq_out_of_range") and reason([None], [2]) == (0, "seq_out_of_range")
    assert reason([0, 0], [2, 2]) == (1, "seq_repeated") and reason([1], [2], 1, 2, [1]) == (0, "seq_repeated")
