"""Queries on device commands, in batch and as drained streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.functions.payloads import command_reason
from hearken.operators import commands
from hearken.plans.registry import Inputs, query
from hearken.session import scratch_dir
from hearken.streaming import stateful

CHANGES = """prev as (select *, lag(value) over (partition by device, capability order by ts, seq) as old from v_commands),
chg as (select *, row_number() over (partition by device order by ts, seq) as change_no from prev
        where old is null or old <> value)"""


def timed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@query("change_events", f"with {CHANGES} select device, change_no, ts, seq, capability, old, value as new from chg")
def _(t: Inputs):
    return commands.change_events(t.v_commands)


@query(
    "latest_state",
    """select device, capability, value from v_commands
       qualify row_number() over (partition by device, capability order by ts desc, seq desc) = 1""",
)
def _(t: Inputs):
    return commands.latest_state(t.v_commands)


@query(
    "command_atomic_reject",
    """with e as (select command_id, case capability
         when 'power' then value_type <> 'boolean'
         when 'fan_speed' then value not in ('low', 'mid', 'high')
         when 'mode' then value not in ('cool', 'heat', 'dry', 'auto')
         when 'target_temp' then not (try_cast(value as int) between 0 and 40)
         when 'humidity' then not (try_cast(value as int) between 0 and 100)
         when 'timer_min' then not (try_cast(value as int) between 0 and 1440)
         else true end as bad from v_command_items)
       select command_id, count(*) as n_items, count(*) filter (where bad) as n_errors,
              not bool_or(bad) as accepted from e group by command_id""",
)
def _(t: Inputs):
    return commands.judged_commands(t.v_command_items)


REPLAY = """o as (select *, count(*) filter (where kind = 'issue') over (partition by device order by ts, seq) as epoch,
         last_value(case when kind = 'issue' then nonce end ignore nulls) over (partition by device order by ts, seq
           rows between unbounded preceding and current row) as live from v_challenges),
a as (select *, coalesce(nonce = live, false) and epoch > 0 as hit from o where kind = 'attempt'),
f as (select *, coalesce(sum(case when hit then 1 else 0 end) over (partition by device, epoch order by ts, seq
        rows between unbounded preceding and 1 preceding), 0) as used from a)
select device, seq, case when epoch = 0 or used > 0 then 'no_challenge' when nonce is null then 'malformed'
  when hit then 'accepted' else 'mismatch' end as outcome from f"""


@query("replay_guard", f"with {REPLAY}")
def _(t: Inputs):
    return commands.replay_guard(t.v_challenges)


FRAMES = """with g as (select msg_id, count(*) as n_frames, min(total) as lo, max(total) as hi,
         count(distinct seq_no) as n_seq, min(seq_no) as a, max(seq_no) as z,
         string_agg(payload, '' order by seq_no) as text from v_frames group by msg_id),
       r as (select *, case when n_frames > 255 then 'too_many_frames' when lo < 1 then 'total_invalid'
         when lo <> hi then 'totals_differ' when lo <> n_frames then 'total_not_received'
         when a < 0 or z >= lo then 'seq_out_of_range' when n_seq < n_frames then 'seq_repeated'
         when strlen(text) > 1024 then 'too_large' else 'complete' end as outcome from g)
       select msg_id, n_frames, outcome, case when outcome = 'complete' then text end as message from r"""


@query("frame_reassembly", FRAMES)
def _(t: Inputs):
    return commands.reassemble(t.v_frames)


@query(
    "payload_audit",
    """with p as (select event_id, case event_id % 8
         when 0 then '{"v":1,"device_ref":"d","set":{"k":' || cast(event_id as varchar) || '}}'
         when 1 then '{"v":2,"device_ref":"d","set":{}}'
         when 2 then '{"v":1,"v":1,"device_ref":"d","set":{}}'
         when 3 then '[1,2]' when 4 then '{"v":1,' when 5 then '{"v":1,"device_ref":"d","set":{}} x'
         when 6 then '{"v":1,"device_ref":7,"set":{}}'
         else repeat('x', 1025) end as payload from events)
       select event_id, case event_id % 8 when 0 then 'accepted' when 1 then 'version' when 2 then 'repeated_key'
         when 3 then 'not_an_object' when 4 then 'not_json' when 5 then 'trailing_text' when 6 then 'device_ref'
         else 'too_large' end as outcome from p""",
)
def _(t: Inputs):
    shapes = {
        1: '{"v":2,"device_ref":"d","set":{}}',
        2: '{"v":1,"v":1,"device_ref":"d","set":{}}',
        3: "[1,2]",
        4: '{"v":1,',
        5: '{"v":1,"device_ref":"d","set":{}} x',
        6: '{"v":1,"device_ref":7,"set":{}}',
        7: "x" * 1025,
    }
    good = F.concat(
        F.lit('{"v":1,"device_ref":"d","set":{"k":'), F.col("event_id").cast("string"), F.lit("}}")
    )
    payload = good
    for i, text in shapes.items():
        payload = F.when(F.col("event_id") % 8 == i, F.lit(text)).otherwise(payload)
    landed = t.events.select("event_id", payload.alias("payload"))
    return landed.select("event_id", command_reason(F.col("payload")).alias("outcome"))


@query(
    "payload_audit_props",
    """select case when props is null then 'missing' when json_extract_string(props, '$.v') is null then 'version'
       else 'accepted' end as outcome, count(*) as n from events group by 1""",
)
def _(t: Inputs):
    return t.events.groupBy(command_reason(F.col("props")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# --- the same as streams over landed files -----------------------------------------------------


def run_stream(t: Inputs, source: DataFrame, build, purpose: str, closing: list[DataFrame] | None = None) -> DataFrame:
    """Land the source as files, drain the stream over them, read what it wrote.

    Each closing table lands later, as a file of its own that moves the watermark on.
    """
    stateful.use_state_store(t.spark)
    base = scratch_dir(t.spark, purpose)
    source.write.parquet(f"{base}/in")
    stream = build(stateful.landed(t.spark, f"{base}/in", source.schema))
    stateful.drain(stream, f"{base}/out", f"{base}/checkpoint")
    for marker in closing or []:
        marker.write.mode("append").parquet(f"{base}/in")
        stateful.drain(stream, f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


@query(
    "stream_change_events",
    f"with {CHANGES} select device, capability, ts, seq, old, value as new from chg",
)
def _(t: Inputs):
    return run_stream(t, timed(t.v_commands), stateful.change_events, "changes")


@query("stream_replay_guard", f"with {REPLAY}")
def _(t: Inputs):
    return run_stream(t, timed(t.v_challenges), stateful.replay_guard, "replay")


@query("stream_frame_reassembly", FRAMES)
def _(t: Inputs):
    """All outcomes: two closing markers, messages -1 and -2, move the watermark past the last frame, so that
    incomplete messages time out."""
    # a stream's watermark starts at 1970-01-01 00:00 and frames at or before it are late
    arrived = F.timestamp_seconds(F.col("msg_id") * 60 + F.col("seq_no") + 3600)
    frames = t.v_frames.withColumn("ts", arrived)
    last = frames.agg(F.max("ts").alias("ts"))
    cells = {"msg_id": F.lit(-1), "seq_no": F.lit(0), "total": F.lit(1), "payload": F.lit(""), "ts": F.col("ts")}

    def marker(day: int) -> DataFrame:
        own = cells | {"msg_id": F.lit(-day), "ts": F.col("ts") + F.make_dt_interval(F.lit(day))}
        return last.select(*[own[f.name].cast(f.dataType).alias(f.name) for f in frames.schema])

    done = run_stream(t, frames, stateful.reassemble, "frames", [marker(1), marker(2)])
    return done.filter("msg_id >= 0")


@query("ingest_checkpoint", "select page_id, url, html from pages")
def _(t: Inputs):
    """Pages landed in two instalments, drained by two runs over one checkpoint."""
    base = scratch_dir(t.spark, "ingest")
    pages = t.pages
    for half in (0, 1):
        pages.filter(F.pmod(F.xxhash64("url"), F.lit(2)) == half).write.mode("append").parquet(f"{base}/in")
        stream = stateful.landed(t.spark, f"{base}/in", pages.schema, files_per_batch=4)
        stateful.drain(stream, f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.schema(pages.schema).parquet(f"{base}/out")
