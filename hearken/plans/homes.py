"""Queries on fleets of home profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearken.functions import privacy
from hearken.operators import crosswalk, fleet, store
from hearken.plans.registry import Inputs, query
from hearken.session import materialize
from hearken.sources import profiles

TOKEN = "^[a-z0-9][a-z0-9_-]{0,31}$"
KEY = "^[a-z0-9][a-z0-9_]{0,31}$"


def lines(t: Inputs):
    """The order lines of all homes in numbers only: what devices, actions and requests are made of. Lines meet their
    orders and parts once per query; texts are built by those who read them."""
    return t.once("lines", build_lines)


def build_lines(t: Inputs):
    ordered = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("home_id"))
    sized = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size", F.lit(True).alias("has_part"))
    rows = t.lineitem.join(ordered, "l_orderkey").join(sized, "l_partkey", "left")
    return rows.select(
        "home_id", F.col("l_orderkey").alias("routine_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_no"), F.col("l_suppkey").alias("supp_no"),
        F.col("l_quantity").cast("int").alias("quantity"), (F.col("p_size") % 2).alias("size_rest"),
        (F.col("l_tax") > 0.075).alias("ghost"), (F.col("l_tax") < 0.075).alias("asked"),
        (F.col("l_discount") > 0.095).alias("odd"), F.coalesce("has_part", F.lit(False)).alias("has_part"),
    )


def devices(t: Inputs):
    """Device registry of the fleet; a stored table in practice, so it is written once per query."""
    return t.once("devices", build_devices)


def build_devices(t: Inputs):
    """The rows of v_devices: pairs of home and part are made distinct as numbers, before the texts of the part join them."""
    kind = F.when(F.col("p_partkey") % 50 == 0, F.col("p_type")).otherwise(F.lower("p_type"))
    caps = (F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), size_key(F.col("p_size") % 2))
    parts = t.part.select(F.col("p_partkey").alias("pos"), kind.alias("device_type"), F.array(*caps).alias("capabilities")).distinct()
    pairs = lines(t).filter("has_part").select("home_id", F.col("part_no").alias("pos")).distinct()
    return pairs.join(parts, "pos").select("home_id", "pos", part_ref("p", F.col("pos")).alias("device_ref"), "device_type", "capabilities")


def part_ref(prefix, number):
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, number.cast("string"))


def size_key(rest):
    return F.concat(F.lit("size_"), rest.cast("string"))


def actions(t: Inputs):
    """Routine actions of the fleet, the rows of v_actions."""
    return lines(t).filter("has_part").select(
        "home_id", "routine_id", "line_no", "part_no", "supp_no",
        part_ref(F.when(F.col("ghost"), "ghost").otherwise("p"), F.col("part_no")).alias("device_ref"),
        F.when(F.col("odd"), "odd_key").otherwise(size_key(F.col("size_rest"))).alias("setting_key"),
        F.col("quantity").cast("string").alias("value"),
    )


def settings(t: Inputs):
    """The two settings of every device, from the same registry (see v_settings)."""
    first = F.struct(
        F.col("capabilities")[0].alias("setting_key"), (F.col("pos") % 40).cast("string").alias("value")
    )
    odd = F.when(F.col("pos") % 4 == 0, "odd_key").otherwise(F.col("capabilities")[1])
    text = F.when(F.col("pos") % 70 == 0, F.repeat(F.lit("v"), 70)).otherwise(
        F.concat(F.lit("v"), (F.col("pos") % 9).cast("string"))
    )
    second = F.struct(odd.alias("setting_key"), text.alias("value"))
    rows = devices(t).select("home_id", "device_ref", F.explode(F.array(first, second)).alias("s"))
    return rows.select("home_id", "device_ref", "s.*")


def violation_sql(source: str, rules: dict[str, str], item: str) -> str:
    return " union all ".join(
        f"select home_id, cast({item} as varchar) as item, '{code}' as rule from {source} where {bad}"
        for code, bad in rules.items()
    )


DEVICE_VIOLATIONS = (
    violation_sql(
        "v_devices",
        {
            "device_ref_shape": f"not regexp_matches(device_ref, '{TOKEN}')",
            "device_type_shape": f"not regexp_matches(device_type, '{KEY}')",
            "capability_shape": f"not regexp_matches(cap1, '{KEY}') or not regexp_matches(cap2, '{KEY}')",
        },
        "device_ref",
    )
    + """ union all select home_id, device_ref, 'device_ref_repeated' from v_devices
          group by 1, 2 having count(*) > 1
          union all select home_id, cast(home_id as varchar), 'device_count' from v_devices
          group by home_id having count(*) > 30"""
)
VIOLATIONS = (
    DEVICE_VIOLATIONS
    + " union all "
    + violation_sql(
        "v_settings",
        {
            "setting_ref_shape": f"not regexp_matches(device_ref, '{TOKEN}')",
            "setting_key_shape": f"not regexp_matches(setting_key, '{KEY}')",
            "setting_value_length": "length(value) > 64",
            "setting_ghost_device": "(home_id, device_ref) not in (select (home_id, device_ref) from v_devices)",
        },
        "device_ref",
    )
    + " union all "
    + violation_sql(
        "v_actions",
        {
            "action_ref_shape": f"not regexp_matches(device_ref, '{TOKEN}')",
            "action_key_shape": f"not regexp_matches(setting_key, '{KEY}')",
            "action_value_length": "length(value) > 64",
            "action_ghost_device": "(home_id, device_ref) not in (select (home_id, device_ref) from v_devices)",
        },
        "routine_id",
    )
    + """ union all select home_id, device_ref, 'setting_count' from v_settings group by 1, 2 having count(*) > 12
          union all select home_id, cast(routine_id as varchar), 'action_count' from v_actions
          group by home_id, routine_id having count(*) > 10
          union all select home_id, cast(home_id as varchar), 'routine_count'
          from (select distinct home_id, routine_id from v_actions) group by home_id having count(*) > 20"""
)


@query("profile_violations", VIOLATIONS)
def _(t: Inputs):
    return fleet.violations(devices(t), settings(t), actions(t))


@query(
    "ghost_refs",
    """select home_id, routine_id, device_ref from v_actions a
       where not exists (select 1 from v_devices d where d.home_id = a.home_id and d.device_ref = a.device_ref)""",
)
def _(t: Inputs):
    return fleet.ghosts(actions(t), devices(t)).select("home_id", "routine_id", "device_ref")


@query(
    "onboard_eligible",
    f"""select home_id, count(*) as devices_connected from v_devices
        where home_id not in (select home_id from ({DEVICE_VIOLATIONS}))
          and home_id not in (select o_custkey from orders where o_totalprice > 450000)
        group by home_id""",
)
def _(t: Inputs):
    existing = t.orders.filter(F.col("o_totalprice") > 450000).select(F.col("o_custkey").alias("home_id"))
    return fleet.onboardable(devices(t), existing)


@query(
    "routine_commands",
    """with k as (select a.home_id, a.routine_id, a.device_ref, a.setting_key,
         last(a.value order by line_no, part_no, supp_no, a.value) as value,
         bool_and(d.device_ref is not null and a.setting_key in (d.cap1, d.cap2)) as fits
         from v_actions a left join v_devices d on d.home_id = a.home_id and d.device_ref = a.device_ref
         group by 1, 2, 3, 4),
       ok as (select home_id, routine_id from k group by 1, 2 having bool_and(fits))
       select k.home_id, k.routine_id, device_ref, '{' || array_to_string(
           list('"' || setting_key || '":"' || value || '"' order by setting_key), ',') || '}' as command
       from k join ok on ok.home_id = k.home_id and ok.routine_id = k.routine_id group by 1, 2, 3""",
)
def _(t: Inputs):
    return fleet.routine_commands(actions(t), devices(t))


LETTER = r"[\p{L}\p{N}_"
SPACE = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}-]?"
VALUE_SQL = {
    "hidden_characters": r"regexp_matches(text, '\p{Cf}')",
    "too_long": "length(text) > 256",
    "email": rf"regexp_matches(text, '{LETTER}.+-]+@{LETTER}-]+\.{LETTER}.]+')",
    "phone": rf"regexp_matches(text, '01[016789]{SPACE}\p{{Nd}}{{3,4}}{SPACE}\p{{Nd}}{{4}}')",
    "national_id": rf"regexp_matches(text, '\p{{Nd}}{{6}}{SPACE}[1-4]\p{{Nd}}{{6}}')",
    "identifier_phrase": "regexp_matches(text, '이름|전화번호|주민등록|성명|연락처')",
}
TEXTS = """texts as (select 'documents' as source, doc_id as id, text from documents union all
    select 'conversations', conv_id * 1000 + turn, text from conversations union all
    select 'pages', page_id, html from pages)"""


@query(
    "identifier_scan",
    f"with {TEXTS} "
    + " union all ".join(f"select source, id, '{r}' as rule from texts where {c}" for r, c in VALUE_SQL.items()),
)
def _(t: Inputs):
    texts = (
        t.documents.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
        .unionByName(
            t.conversations.select(
                F.lit("conversations").alias("source"),
                (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                "text",
            )
        )
        .unionByName(
            t.pages.select(
                F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text")
            )
        )
    )
    return fleet.text_identifiers(texts)


@query(
    "identifier_key_scan",
    """with k as (select lower(p_name) as key, count(*) as n from part group by 1)
       select key, n, 'key_wellness' as rule from k where regexp_matches(key, 'sleep|wellness|health|heart|hrv|blood|spo2|stress|body_fat|bp_|calorie|weight|pulse|glucose')
       union all select key, n, 'key_identifier' from k where regexp_matches(key, 'name|account|email|phone|user_id|userid|birth|address|contact|ssn|gender|owner|resident|alias|nickname')
       union all select c_name, count(*), 'key_not_ascii' from customer where regexp_matches(c_name, '[^\\x00-\\x7F]') group by 1
       union all select 'email_' || c_mktsegment, count(*), 'key_identifier' from customer group by 1
       union all select 'sleep_' || c_mktsegment, count(*), 'key_wellness' from customer group by 1""",
)
def _(t: Inputs):
    names = t.part.select(F.lower("p_name").alias("key")).unionByName(t.customer.select(F.col("c_name").alias("key")))
    for prefix in ("email_", "sleep_"):
        names = names.unionByName(
            t.customer.select(F.concat(F.lit(prefix), "c_mktsegment").alias("key"))
        )
    return fleet.key_identifiers(names, "key")


@query(
    "redact",
    """select conv_id, turn, '<str len=' || length(text) || ' #' || substr(sha256(text), 1, 4) || '>' as shown
       from conversations""",
)
def _(t: Inputs):
    return t.conversations.select("conv_id", "turn", privacy.redact(F.col("text")).alias("shown"))


# --- records ---------------------------------------------------------------------------------

RECORDS = """nd as (select home_id, count(*) as n_devices from v_devices group by 1),
nr as (select home_id, count(*) as n_routines, max(n) as max_actions
       from (select home_id, routine_id, count(*) as n from v_actions group by 1, 2) group by 1),
lim as (select nd.home_id, coalesce(n_routines, 0) as n_routines, case when n_devices > 30 then 'device_count'
          when n_routines > 20 then 'routine_count' when max_actions > 10 then 'action_count'
          when nd.home_id in (select home_id from v_settings group by home_id, device_ref having count(*) > 12)
          then 'setting_count' else 'ok' end as outcome
        from nd left join nr on nr.home_id = nd.home_id),
ok as (select home_id, n_routines from lim where outcome = 'ok'),
refused as (select home_id, outcome from lim where outcome <> 'ok'),
st as (select home_id, device_ref, '{' || array_to_string(
         list('"' || setting_key || '":"' || value || '"' order by setting_key), ',') || '}' as settings
       from v_settings group by 1, 2),
dv as (select d.home_id, d.pos, d.device_ref, '{"device_ref":"' || d.device_ref || '","device_type":"' || device_type
         || '","capabilities":["' || cap1 || '","' || cap2 || '"]' as body, st.settings
       from v_devices d join st on st.home_id = d.home_id and st.device_ref = d.device_ref
       where d.home_id in (select home_id from ok)),
rt as (select home_id, routine_id, '{"trigger":{"type":"time"},"actions":[' || array_to_string(
         list('{"device_ref":"' || device_ref || '","setting_key":"' || setting_key || '","value":"' || value || '"}'
              order by line_no, part_no, supp_no, value), ',') || ']}' as payload
       from v_actions where home_id in (select home_id from ok) group by 1, 2),
rec as (select ok.home_id, 'meta' as name, '{"schema_version":"1.0.0","reserved_wellness":{},"device_refs":["'
          || array_to_string(list(dv.device_ref order by pos), '","') || '"],"routine_count":' || ok.n_routines || '}'
          as payload from ok join dv on dv.home_id = ok.home_id group by ok.home_id, ok.n_routines
        union all select home_id, 'device:' || device_ref, body || ',"_settings":' || settings || '}' from dv
        union all select home_id, 'routine:' || (row_number() over (partition by home_id order by routine_id) - 1),
          payload from rt)"""


def every_home(sql: str) -> str:
    return f"select *, 'ok' as outcome from ({sql}) union all by name select home_id, outcome from refused"


def limits(t: Inputs):
    return t.once("limits", lambda i: fleet.limit_outcomes(devices(i), actions(i), settings(i)))


def fitting(t: Inputs):
    return limits(t).filter("outcome = 'ok'").drop("outcome")


def with_refused(t: Inputs, df):
    """The rows with outcome `ok`, and one row for every home beyond a limit, which is its outcome."""
    refused = limits(t).filter("outcome <> 'ok'").select("home_id", "outcome")
    return df.withColumn("outcome", F.lit("ok")).unionByName(refused, allowMissingColumns=True)


def records(t: Inputs):
    return store.split(fitting(t), devices(t), settings(t), actions(t))


@query("chunk_split", f"with {RECORDS} {every_home('select home_id, name, payload from rec')}")
def _(t: Inputs):
    return with_refused(t, records(t))


@query(
    "chunk_merge",
    f"""with {RECORDS}, whole as (select ok.home_id, '{{"schema_version":"1.0.0","devices":['
        || (select array_to_string(list(body || '}}' order by pos), ',') from dv where dv.home_id = ok.home_id)
        || '],"settings":{{' || (select array_to_string(list('"' || device_ref || '":' || settings order by pos), ',')
            from dv where dv.home_id = ok.home_id)
        || '}},"routines":[' || coalesce((select array_to_string(list(payload order by routine_id), ',')
            from rt where rt.home_id = ok.home_id), '') || '],"reserved_wellness":{{}}}}' as profile from ok)
        {every_home("from whole")}""",
)
def _(t: Inputs):
    return with_refused(t, store.merge(materialize(records(t), "records")))


@query(
    "residency_footprint",
    f"""with {RECORDS}, parts as (select home_id, split_part(name, ':', 1) as kind, count(*) as n_records,
        cast(sum(strlen(name) + strlen(payload)) as bigint) as n_bytes from rec group by 1, 2) {every_home("from parts")}""",
)
def _(t: Inputs):
    return with_refused(t, store.footprint(records(t)))


@query(
    "store_put_audit",
    f"""with {RECORDS}, batches as (select home_id, count(*) as n_records, max(strlen(payload)) as largest_bytes,
        cast(sum(strlen(name) + strlen(payload)) as bigint) as total_bytes,
        count(*) filter (where payload is null or name = '') as n_malformed,
        max(strlen(payload)) <= 4096 and sum(strlen(name) + strlen(payload)) <= 131072 as accepted
        from rec group by home_id)
        select * replace (coalesce(accepted, false) as accepted) from ({every_home("from batches")})""",
)
def _(t: Inputs):
    return with_refused(t, store.put_audit(records(t))).withColumn("accepted", F.coalesce("accepted", F.lit(False)))


@query(
    "size_report",
    f"""with {RECORDS},
    p as (select home_id, sum(strlen(body) + 1) + count(*) - 1 as d,
                 sum(strlen(settings) + strlen(device_ref) + 3) + count(*) - 1 as s from dv group by home_id),
    r as (select home_id, sum(strlen(payload)) + count(*) - 1 as r from rt group by home_id),
    tot as (select p.home_id, cast(strlen('{{"schema_version":"1.0.0","devices":[],"settings":{{}},"routines":[],"reserved_wellness":{{}}}}') + d + s + coalesce(r, 0) as bigint) as total_bytes
            from p left join r on r.home_id = p.home_id),
    g as (select home_id, count(*) as n_keys, max(strlen(payload)) as largest_chunk_bytes,
            max(strlen(payload)) <= 4096 as per_key_ok,
            round(avg(strlen(payload)) filter (where starts_with(name, 'device:')), 6) as bytes_per_device,
            round(avg(strlen(payload)) filter (where starts_with(name, 'routine:')), 6) as bytes_per_routine
          from rec group by home_id),
    big as (select home_id, name as largest_chunk from rec
            qualify row_number() over (partition by home_id order by strlen(payload) desc, name desc) = 1),
    sizes as (select g.*, largest_chunk, total_bytes, total_bytes <= 131072 as total_within_budget,
           cast(ceil(total_bytes / 20) as bigint) as frames
    from g join big on big.home_id = g.home_id join tot on tot.home_id = g.home_id) {every_home("from sizes")}""",
)
def _(t: Inputs):
    kept = fitting(t).select("home_id")
    parts = store.device_records(
        devices(t).join(kept, "home_id", "left_semi"), settings(t).join(kept, "home_id", "left_semi")
    )
    return with_refused(t, store.size_report(records(t), parts))


# the stored names of a fleet: one record per device, meta from the same devices
STORED = """meta as (select home_id, list('device:' || device_ref) as refs from v_devices
    group by home_id having count(*) <= 30),
stored as (select home_id, 'device:' || device_ref as name from v_devices
           union all select home_id, 'meta' from meta
           union all select distinct home_id, 'routine:' || routine_id from v_actions)"""


def stored(t: Inputs):
    return t.once("stored", build_stored)


def build_stored(t: Inputs):
    """Names and payloads; routine records are not in any meta, and large homes have no meta."""
    d = devices(t)
    sized = d.groupBy("home_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= 30)
    refs = F.sort_array(F.collect_list("device_ref"))
    small = d.join(sized, "home_id", "left_semi").groupBy("home_id").agg(refs.alias("device_refs"))
    meta = small.select(
        "home_id",
        F.lit("meta").alias("name"),
        F.to_json(F.struct("device_refs", F.lit(0).alias("routine_count"))).alias("payload"),
    )
    device = d.select("home_id", F.concat(F.lit("device:"), "device_ref").alias("name"), F.lit("{}").alias("payload"))
    routine = actions(t).select("home_id", "routine_id").distinct().select(
        "home_id",
        F.concat(F.lit("routine:"), F.col("routine_id").cast("string")).alias("name"),
        F.lit("{}").alias("payload"),
    )
    return meta.unionByName(device).unionByName(routine)


@query(
    "except_chunks",
    f"""with {STORED} select home_id, name from stored
        except select home_id, unnest(list_append(refs, 'meta')) from meta""",
)
def _(t: Inputs):
    return store.unreferenced(stored(t))


REQUESTS = """req as (select o_custkey as home_id, 'device:' || 'p' || l_partkey as name from lineitem
    join orders on o_orderkey = l_orderkey where l_tax < 0.075
    union select o_custkey, case when o_totalprice > 480000 then 'device:unknown' else 'meta' end from orders
    where o_custkey in (select home_id from meta))"""


def requests(t: Inputs):
    return t.once("requests", build_requests)


def build_requests(t: Inputs):
    named = lines(t).filter("asked").select("home_id", "part_no").distinct()
    named = named.select("home_id", part_ref("device:p", F.col("part_no")).alias("name"))
    with_meta = stored(t).filter(F.col("name") == "meta").select("home_id")
    large = F.col("o_totalprice") > 480000
    extra = t.orders.select(F.col("o_custkey").alias("home_id"), F.coalesce(large, F.lit(False)).alias("large")).distinct()
    extra = extra.join(with_meta, "home_id", "left_semi").select(
        "home_id", F.when(F.col("large"), "device:unknown").otherwise("meta").alias("name")
    )
    return named.unionByName(extra)  # both are distinct, and no part is called unknown


ERASED = f"""{STORED}, {REQUESTS},
aud as (select r.home_id, count(*) as n_requested, count(*) filter (where s.name is null) as n_unknown,
          count(*) filter (where s.name is null) = 0 as accepted
        from req r left join (select distinct home_id, name from stored) s
          on s.home_id = r.home_id and s.name = r.name group by r.home_id),
after as (select s.home_id, s.name from stored s where not exists
          (select 1 from req r join aud a on a.home_id = r.home_id where a.accepted
             and r.home_id = s.home_id and r.name = s.name))"""


@query("store_erase_audit", f"with {ERASED} select * from aud")
def _(t: Inputs):
    return store.erase_audit(stored(t), requests(t))


@query("store_erase", f"with {ERASED} select home_id, name from after")
def _(t: Inputs):
    return store.erase(stored(t), requests(t)).select("home_id", "name")


@query(
    "residue_audit",
    f"""with {ERASED}, revoked as (select distinct home_id from req),
    want as (select home_id, unnest(list_append(refs, 'meta')) as name from meta),
    left_ as (select w.home_id, count(a.name) as residual_records from want w
              left join (select distinct home_id, name from after) a on a.home_id = w.home_id and a.name = w.name
              where w.home_id in (select home_id from revoked) group by w.home_id)
    select r.home_id, residual_records from revoked r left join left_ on left_.home_id = r.home_id""",
)
def _(t: Inputs):
    before = stored(t)
    revoked = requests(t).select("home_id").distinct()
    return store.residue(revoked, before, store.erase(before, requests(t)))


# --- crosswalk -------------------------------------------------------------------------------

CROSSWALK = """nd as (select home_id, count(*) as n from v_devices group by 1),
homes as (select o.home_id, o.n > 30 as rejected, coalesce(n.n > 30, false) as aborted from nd o
          left join nd n on n.home_id = o.home_id + 1),
od as (select d.*, row_number() over (partition by home_id, device_type order by pos, device_ref) as nth
       from v_devices d),
nw as (select home_id - 1 as home_id, device_ref as new_ref, device_type, cap1 as c1, cap2 as c2,
         row_number() over (partition by home_id, device_type order by pos, device_ref) as nth
       from v_devices where home_id - 1 in (select home_id from homes where not aborted and not rejected)),
mt as (select od.home_id, od.device_ref as old_ref, od.device_type, nw.new_ref, nw.c1, nw.c2, h.rejected, h.aborted,
         case when h.rejected then 'profile_rejected' when h.aborted then 'mapping_aborted' when nw.new_ref is null then 'no_matching_type' end as reason
       from od join homes h on h.home_id = od.home_id
       left join nw on nw.home_id = od.home_id and nw.device_type = od.device_type and nw.nth = od.nth),
sm as (select s.home_id, s.device_ref, s.setting_key, s.value, mt.new_ref,
         case when mt.rejected then 'profile_rejected' when mt.aborted then 'mapping_aborted' when mt.new_ref is null then 'no_matching_type'
              when s.setting_key not in (mt.c1, mt.c2) then 'capability_unsupported' end as reason
       from v_settings s join mt on mt.home_id = s.home_id and mt.old_ref = s.device_ref),
rm as (select a.home_id, a.routine_id, case when bool_or(h.rejected) then 'profile_rejected'
         when bool_or(h.aborted) then 'mapping_aborted'
         when not bool_and(coalesce(mt.new_ref is not null and a.setting_key in (mt.c1, mt.c2), false))
         then 'routine_action_unmappable' end as reason
       from v_actions a join homes h on h.home_id = a.home_id
       left join mt on mt.home_id = a.home_id and mt.old_ref = a.device_ref group by 1, 2)"""


def new_homes(t: Inputs):
    """The devices of the next home are what a home moves to."""
    return devices(t).withColumn("home_id", F.col("home_id") - 1)


def moved(t: Inputs):
    homes = t.once("homes", lambda i: crosswalk.movable(devices(i), new_homes(i)))
    return homes, crosswalk.match_devices(devices(t), new_homes(t), homes)


@query("crosswalk_match", f"with {CROSSWALK} select home_id, old_ref, device_type, new_ref, reason from mt")
def _(t: Inputs):
    _homes, matches = moved(t)
    return matches.select("home_id", "old_ref", "device_type", "new_ref", "reason")


@query("crosswalk_settings", f"with {CROSSWALK} select home_id, device_ref, setting_key, new_ref, reason from sm")
def _(t: Inputs):
    _homes, matches = moved(t)
    return crosswalk.map_settings(settings(t), matches).drop("value")


@query("crosswalk_routines", f"with {CROSSWALK} select home_id, routine_id, reason from rm")
def _(t: Inputs):
    homes, matches = moved(t)
    return crosswalk.map_routines(actions(t), matches, homes)


@query(
    "crosswalk_actions",
    f"""with {CROSSWALK} select a.home_id, a.routine_id, a.device_ref, a.setting_key, a.value, mt.new_ref
        from v_actions a join rm on rm.home_id = a.home_id and rm.routine_id = a.routine_id and rm.reason is null
        join mt on mt.home_id = a.home_id and mt.old_ref = a.device_ref""",
)
def _(t: Inputs):
    homes, matches = moved(t)
    routines = crosswalk.map_routines(actions(t), matches, homes)
    kept = crosswalk.remapped_actions(actions(t), matches, routines)
    return kept.select("home_id", "routine_id", "device_ref", "setting_key", "value", "new_ref")


@query(
    "crosswalk_unmatched",
    f"""with {CROSSWALK} select home_id, new_ref as device_ref from nw
        except select home_id, new_ref from mt where new_ref is not null""",
)
def _(t: Inputs):
    homes, matches = moved(t)
    return crosswalk.unmatched_new(new_homes(t), homes, matches)


@query(
    "crosswalk_report",
    f"""with {CROSSWALK}
    select home_id, 'device' as kind, coalesce(reason, 'transferred') as outcome, count(*) as n from mt group by 1, 3
    union all select home_id, 'setting', coalesce(reason, 'transferred'), count(*) from sm group by 1, 3
    union all select home_id, 'routine', coalesce(reason, 'transferred'), count(*) from rm group by 1, 3""",
)
def _(t: Inputs):
    homes, matches = moved(t)
    mapped = crosswalk.map_settings(settings(t), matches)
    return crosswalk.report(matches, mapped, crosswalk.map_routines(actions(t), matches, homes))


# --- landed profiles -------------------------------------------------------------------------


def landed_profiles(t: Inputs):
    """Whole profiles as JSON text, put together from the records of the homes."""
    return t.once("profiles", lambda i: store.merge(i.once("records", records))).select(
        "home_id", F.col("profile").alias("payload")
    )


@query(
    "src_profile_settings",
    f"""with {RECORDS}
        {every_home("select home_id, device_ref, setting_key, value from v_settings where home_id in (select home_id from ok)")}""",
)
def _(t: Inputs):
    return with_refused(t, profiles.settings(profiles.accepted(landed_profiles(t))))


@query(
    "src_profile_actions",
    f"""with {RECORDS}, steps as (
        select home_id, row_number() over (partition by home_id order by routine_id) - 1 as routine_id, n as n_actions
        from (select home_id, routine_id, count(*) as n from v_actions
              where home_id in (select home_id from ok) group by 1, 2)) {every_home("from steps")}""",
)
def _(t: Inputs):
    steps = profiles.actions(profiles.accepted(landed_profiles(t)))
    return with_refused(t, steps.groupBy("home_id", "routine_id").agg(F.count(F.lit(1)).alias("n_actions")))


@query(
    "profile_payload_audit",
    f"""with {RECORDS} select home_id, case home_id % 5 when 0 then 'accepted' when 1 then 'version'
        when 2 then 'unknown_key' when 3 then 'trailing_text' else 'reserved_not_empty' end as outcome from ok
        union all from refused""",
)
def _(t: Inputs):
    p = F.col("payload")
    kind = F.col("home_id") % 5
    damaged = (
        F.when(kind == 1, F.regexp_replace(p, '"1.0.0"', '"9.0.0"'))
        .when(kind == 2, F.regexp_replace(p, '"routines":', '"x":1,"routines":'))
        .when(kind == 3, F.concat(p, F.lit("}")))
        .when(kind == 4, F.regexp_replace(p, r'"reserved_wellness":\{\}', '"reserved_wellness":{"a":1}'))
        .otherwise(p)
    )
    judged = landed_profiles(t).select("home_id", profiles.profile_reason(damaged).alias("outcome"))
    return judged.unionByName(limits(t).filter("outcome <> 'ok'").select("home_id", "outcome"))
