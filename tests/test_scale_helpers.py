"""The bucketed helpers give what one big window would give, also when one key holds most rows."""

import random
import statistics

from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from hearken.operators import cleaning, commands, ordered, painpoints, vectors


def skewed(spark, n=600):
    rng = random.Random(7)
    data = [
        (i, f"2024-01-{1 + rng.randrange(9):02d} {rng.randrange(24):02d}:00:00",
         "hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", rng.choice("ab"), rng.randrange(3))
        for i in range(n)
    ]
    df = spark.createDataFrame(data, "seq long, ts string, device string, capability string, value int")
    return df.withColumn("ts", F.to_timestamp("ts")).repartition(5)


def test_change_events_equal_the_plain_window(spark):
    df = skewed(spark)
    by = Window.partitionBy("device", "capability").orderBy("ts", "seq")
    plain = df.withColumn("old", F.lag("value").over(by)).filter("old is null or old <> value")
    number = F.row_number().over(Window.partitionBy("device").orderBy("ts", "seq"))
    want = rows(plain.withColumn("change_no", number), "device", "change_no", "seq", "old")
    for parts in (1, 2, 7, 300):
        got = commands.change_events(df, parts)
        assert rows(got, "device", "change_no", "seq", "old") == want


def test_replay_guard_equals_a_sequential_reading(spark):
    rng = random.Random(3)
    base = skewed(spark).select("seq", "ts", "device").collect()
    events = [
        (r["seq"], r["ts"], r["device"], "issue" if rng.random() < 0.3 else "attempt",
         None if rng.random() < 0.1 else str(rng.randrange(2)))
        for r in base
    ]
    df = spark.createDataFrame(events, "seq long, ts timestamp, device string, kind string, nonce string")
    live, want = {}, []
    for seq, _ts, device, kind, nonce in sorted(events, key=lambda e: (e[1], e[0])):
        if kind == "issue":
            live[device] = (nonce,)
        elif live.get(device) is None:
            want.append((device, seq, "no_challenge"))
        elif nonce is None:
            want.append((device, seq, "malformed"))
        elif (nonce,) == live[device]:
            live[device] = None
            want.append((device, seq, "accepted"))
        else:
            want.append((device, seq, "mismatch"))
    for parts in (1, 2, 9, 200):
        assert rows(commands.replay_guard(df, parts), "device", "seq", "outcome") == sorted(want, key=repr)


def test_a_burst_of_one_device_is_spread_and_stays_in_order(spark):
    # one device, all within a second; values repeat in runs, capabilities come late, one challenge waits for parts on end
    data = [(i, "hot", f"c{i // 400}", (i // 3) % 2) for i in range(2000)]
    df = spark.createDataFrame(data, "seq long, device string, capability string, value int").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = commands.change_events(df.repartition(8, "value"), 16)
    last, want = {}, []
    for seq, device, capability, value in data:
        if last.get(capability) != value:
            want.append((device, len(want) + 1, seq, last.get(capability)))
            last[capability] = value
    assert rows(got, "device", "change_no", "seq", "old") == sorted(want, key=repr)
    events = [(i, "hot", "issue" if i == 3 else "attempt", "right" if i in (2, 3, 1500, 1700) else None if i % 7 == 0 else "wrong") for i in range(2000)]
    table = spark.createDataFrame(events, "seq long, device string, kind string, nonce string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    outcomes = {r["seq"]: r["outcome"] for r in commands.replay_guard(table, 16).collect()}
    for i, _, kind, nonce in events:
        if kind == "issue":
            assert i not in outcomes
        elif i < 3 or i > 1500:
            assert outcomes[i] == "no_challenge"
        else:
            assert outcomes[i] == ("accepted" if i == 1500 else "malformed" if nonce is None else "mismatch")


def test_scans_of_odd_tables(spark):
    empty = skewed(spark).limit(0)
    assert rows(commands.change_events(empty)) == []
    assert rows(commands.replay_guard(empty.selectExpr("*", "'issue' as kind", "'x' as nonce"))) == []
    nulls = [(1, None, "a", 1), (2, None, "a", 1), (3, None, "b", 2), (4, "d", "a", 2), (5, None, None, 2)]
    df = spark.createDataFrame(nulls, "seq long, device string, capability string, value int").selectExpr("*", "cast(seq as timestamp) as ts", "map(1, 2) as part", "'z' as carry")
    got = rows(commands.change_events(df, 3), "device", "change_no", "seq", "old", "new")
    assert got == sorted([(None, 1, 1, None, 1), (None, 2, 3, None, 2), (None, 3, 5, None, 2), ("d", 1, 4, None, 2)], key=repr)


def test_scans_shuffle_the_rows_once(spark):
    # the rows are placed by one written shuffle; what is left reads them and the few carries
    plan = commands.change_events(skewed(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Exchange") - plan.count("BroadcastExchange") == 1
    events = skewed(spark).selectExpr("*", "if(value = 0, 'issue', 'attempt') as kind", "cast(value as string) as nonce")
    plan = commands.replay_guard(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Exchange") - plan.count("BroadcastExchange") == 0


def test_exact_medians(spark):
    rng = random.Random(1)
    a = [rng.gauss(0, 1) for _ in range(501)] + [1e9]
    b = [float(rng.randrange(4)) for _ in a]
    c = [5.0 if i % 3 else None for i in range(len(a))]
    df = spark.createDataFrame(list(zip(a, b, c)), "a double, b double, c double").repartition(7)
    got = {r["feature"]: r["median"] for r in ordered.exact_medians(df, ["a", "b", "c"]).collect()}
    assert got == {"a": statistics.median(a), "b": statistics.median(b), "c": 5.0}


def test_first_per_key_under_skew(spark):
    df = spark.range(1000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("review")
    ).repartition(9)
    kept = {r["review"]: r["seq"] for r in cleaning.first_per_key(df, ["review"], ["seq"]).collect()}
    assert kept["hot"] == 0 and kept["k1"] == 1 and len(kept) == 51


def frames(spark, spec):
    data = [(m, s, t, p) for m, parts in spec.items() for s, t, p in parts]
    return spark.createDataFrame(data, "msg_id long, seq_no int, total int, payload string")


def test_frame_rules(spark):
    spec = {
        1: [(1, 2, "b"), (0, 2, "a")],
        2: [(0, 3, "a"), (1, 3, "b")],
        3: [(0, 2, "a"), (0, 2, "b")],
        4: [(0, 2, "a"), (2, 2, "b")],
        5: [(0, 2, "a"), (1, 3, "b")],
        6: [(0, 0, "a")],
        7: [(0, 1, "x" * 1025)],
        8: [(i % 300, 400, "p") for i in range(400)],
        9: [(0, 2, "a"), (None, 2, "b")],
    }
    got = {r["msg_id"]: (r["outcome"], r["message"]) for r in commands.reassemble(frames(spark, spec)).collect()}
    assert got[1] == ("complete", "ab")
    assert [got[i][0] for i in range(2, 10)] == [
        "total_not_received", "seq_repeated", "seq_out_of_range", "totals_differ", "total_invalid",
        "too_large", "too_many_frames", "seq_out_of_range",
    ]
    assert all(got[i][1] is None for i in range(2, 10))


def test_exact_medians_with_far_values(spark):
    rng = random.Random(2)
    a = [rng.gauss(0, 1) for _ in range(20_000)] + [1e300, -1e300, float(1 << 60)]
    b = [float(i % 2) * 1e9 for i in range(len(a))]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double").repartition(5)
    got = {r["feature"]: r["median"] for r in ordered.exact_medians(df, ["a", "b"]).collect()}
    assert got == {"a": statistics.median(a), "b": statistics.median(b)}
    empty = spark.createDataFrame([], "a double, b double")
    assert ordered.exact_medians(empty, ["a", "b"]).count() == 0


def test_no_limits_by_default(spark):
    long = "x" * 5000
    rows = [(i, long + str(i), 0, 1.0, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "seq long, review string, topic int, topic_prob double, rating int")
    assert painpoints.pain_points(df, length=None).first()["rep_review"] == long + "0"
    assert painpoints.pain_points(df).first()["rep_review"] == long[:100]
    docs = spark.createDataFrame([(i, f"word{i} shared") for i in range(2500)], "seq long, tokens string")
    terms = vectors.doc_terms(docs, pairs=False)
    assert vectors.vocabulary(terms).count() == 2501
    assert [r["term"] for r in vectors.vocabulary(terms, least_df=2).collect()] == ["shared"]
    assert vectors.vocabulary(terms, max_terms=7).count() == 7
