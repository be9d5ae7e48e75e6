"""Profiles as records (home_id, name, payload): splitting, merging, sizes, put, erase, residue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearken.functions.fixed_values import (
    FRAME_MTU,
    MAX_DEVICES,
    MAX_ROUTINES,
    RECORD_BUDGET,
    SCHEMA_VERSION,
    STORE_BUDGET,
)
from hearken.operators.fleet import ACTION_ORDER

META = "schema_version string, reserved_wellness map<string,string>, device_refs array<string>, routine_count int"
EMPTY_PROFILE = (
    '{"schema_version":"' + SCHEMA_VERSION + '","devices":[],"settings":{},"routines":[],'
    '"reserved_wellness":{}}'
)


def device_records(devices: DataFrame, settings: DataFrame) -> DataFrame:
    """One record per device with its settings, plus the byte counts of both parts."""
    entries = F.array_sort(F.collect_list(F.struct("setting_key", "value")))
    kept = settings.groupBy("home_id", "device_ref").agg(F.map_from_entries(entries).alias("_settings"))
    joined = devices.join(kept, ["home_id", "device_ref"], "left")
    plain = F.struct("device_ref", "device_type", "capabilities")
    full = F.struct("device_ref", "device_type", "capabilities", "_settings")
    return joined.select(
        "home_id",
        F.concat(F.lit("device:"), "device_ref").alias("name"),
        F.to_json(full).alias("payload"),
        "pos",
        "device_ref",
        F.octet_length(F.to_json(plain)).alias("definition_bytes"),
        F.octet_length(F.to_json("_settings")).alias("settings_bytes"),
    )


def routine_records(actions: DataFrame) -> DataFrame:
    """One record per routine, numbered per home in the order of the routine ids."""
    step = F.struct(*ACTION_ORDER, "device_ref", "setting_key")
    steps = F.transform(
        F.array_sort(F.collect_list(step)),
        lambda a: F.struct(a["device_ref"].alias("device_ref"), a["setting_key"].alias("setting_key"),
                           a["value"].alias("value")),
    )
    routines = actions.groupBy("home_id", "routine_id").agg(steps.alias("actions"))
    position = F.row_number().over(Window.partitionBy("home_id").orderBy("routine_id")) - 1
    trigger = F.struct(F.lit("time").alias("type"))
    return routines.select(
        "home_id",
        F.concat(F.lit("routine:"), position.cast("string")).alias("name"),
        F.to_json(F.struct(trigger.alias("trigger"), "actions")).alias("payload"),
    )


def split(homes: DataFrame, devices: DataFrame, settings: DataFrame, actions: DataFrame) -> DataFrame:
    """Records of the given homes. `homes` must come from fleet.within_limits: it bounds every list
    that is gathered here."""
    keep = homes.select("home_id")
    parts = device_records(
        devices.join(keep, "home_id", "left_semi"), settings.join(keep, "home_id", "left_semi")
    )
    routines = routine_records(actions.join(keep, "home_id", "left_semi"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "device_ref")))
    refs = F.transform(ordered, lambda d: d["device_ref"])
    per_home = parts.groupBy("home_id").agg(refs.alias("device_refs"))
    metas = homes.join(per_home, "home_id").select(
        "home_id",
        F.lit("meta").alias("name"),
        F.to_json(
            F.struct(
                F.lit(SCHEMA_VERSION).alias("schema_version"),
                F.from_json(F.lit("{}"), "map<string,string>").alias("reserved_wellness"),
                "device_refs",
                F.col("n_routines").cast("int").alias("routine_count"),
            )
        ).alias("payload"),
    )
    return metas.unionByName(parts.select("home_id", "name", "payload")).unionByName(routines)


def kind(name: str = "name"):
    return F.substring_index(F.col(name), ":", 1)


def record_bytes():
    return F.octet_length("payload")


def footprint(records: DataFrame) -> DataFrame:
    """Records and bytes, names included, per home and kind."""
    size = F.octet_length("name") + record_bytes()
    return records.groupBy("home_id", kind().alias("kind")).agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(size).alias("n_bytes")
    )


def put_audit(records: DataFrame) -> DataFrame:
    """Is the batch of a home accepted? Every record and the total have to fit."""
    sized = records.groupBy("home_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.max(record_bytes()).cast("bigint").alias("largest_bytes"),
        F.sum(F.octet_length("name") + record_bytes()).alias("total_bytes"),
        F.count_if(F.col("payload").isNull() | (F.coalesce(F.col("name"), F.lit("")) == "")).alias("n_malformed"),
    )
    fits = (F.col("largest_bytes") <= RECORD_BUDGET) & (F.col("total_bytes") <= STORE_BUDGET)
    return sized.withColumn("accepted", F.coalesce(fits & (F.col("n_malformed") == 0), F.lit(False)))


def size_report(records: DataFrame, parts: DataFrame) -> DataFrame:
    """Bytes per profile and per record. A size that cannot be measured stays NULL, never 0.

    The whole-profile size is the empty profile plus the sizes of its parts and the commas and
    keys between them, so no profile has to be put together to be measured.
    """
    by_kind = kind()
    size = record_bytes()
    device = F.when(by_kind == "device", size)
    routine = F.when(by_kind == "routine", size)
    unmeasured = F.count_if(size.isNull())
    per_home = records.groupBy("home_id").agg(
        F.count(F.lit(1)).alias("n_keys"),
        unmeasured.alias("n_unmeasured"),
        F.max_by("name", F.struct(size, F.col("name"))).alias("largest_chunk"),
        F.max(size).cast("bigint").alias("largest_chunk_bytes"),
        F.when(unmeasured == 0, F.every(size <= RECORD_BUDGET)).alias("per_key_ok"),
        F.avg(device).alias("bytes_per_device"),
        F.avg(routine).alias("bytes_per_routine"),
        F.coalesce(F.sum(routine), F.lit(0)).alias("routine_bytes"),
        F.count(routine).alias("n_routines"),
    )
    ref_key = F.octet_length("device_ref") + F.lit(len('"":'))
    per_parts = parts.groupBy("home_id").agg(
        F.sum("definition_bytes").alias("definition_bytes"),
        F.sum(F.col("settings_bytes") + ref_key).alias("settings_bytes"),
        F.count(F.lit(1)).alias("n_devices"),
        F.count("settings_bytes").alias("n_settings"),
    )

    def commas(n: str):
        return F.greatest(F.col(n) - 1, F.lit(0))

    total = (
        F.lit(len(EMPTY_PROFILE))
        + F.col("definition_bytes") + commas("n_devices")
        + F.coalesce(F.col("settings_bytes"), F.lit(0)) + commas("n_settings")
        + F.col("routine_bytes") + commas("n_routines")
    )
    return per_home.join(per_parts, "home_id", "left").select(
        "home_id",
        F.when(F.col("n_unmeasured") == 0, total).alias("total_bytes"),
        "n_keys",
        "largest_chunk",
        "largest_chunk_bytes",
        "per_key_ok",
        F.round("bytes_per_device", 6).alias("bytes_per_device"),
        F.round("bytes_per_routine", 6).alias("bytes_per_routine"),
        F.when(F.col("n_unmeasured") == 0, total <= STORE_BUDGET).alias("total_within_budget"),
        F.when(F.col("n_unmeasured") == 0, F.ceil(total / F.lit(float(FRAME_MTU)))).alias("frames"),
    )


# --- names a meta record stands for ------------------------------------------------------------


def metas(records: DataFrame) -> DataFrame:
    """Parsed meta records; one that does not parse gives NULL fields."""
    meta = F.from_json("payload", META)
    return records.filter(F.col("name") == "meta").select("home_id", meta.alias("m")).select("home_id", "m.*")


def expected_names(parsed: DataFrame) -> DataFrame:
    """(home_id, name) of every record the meta speaks of. Metas over the limits of a profile are
    the caller's to reject first, so the arrays stay short."""
    refs = F.transform(F.coalesce("device_refs", F.array()), lambda r: F.concat(F.lit("device:"), r))
    count = F.coalesce(F.col("routine_count"), F.lit(0))
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    routines = F.transform(numbers, lambda i: F.concat(F.lit("routine:"), i.cast("string")))
    return parsed.select("home_id", F.explode(F.concat(F.array(F.lit("meta")), refs, routines)).alias("name"))


def unreferenced(records: DataFrame) -> DataFrame:
    """Stored names no meta refers to."""
    stored = records.select("home_id", "name")
    return stored.join(expected_names(sane(metas(records))), ["home_id", "name"], "left_anti")


def sane(parsed: DataFrame) -> DataFrame:
    return parsed.filter(
        F.col("device_refs").isNotNull()
        & (F.size("device_refs") <= MAX_DEVICES)
        & F.col("routine_count").between(0, MAX_ROUTINES)
    )


def merge_audit(records: DataFrame) -> DataFrame:
    """Per home: may its records be merged, and if not, why not."""
    parsed = metas(records)
    wanted = expected_names(sane(parsed)).withColumn("wanted", F.lit(True))
    stored = records.select("home_id", "name").withColumn("stored", F.lit(True))
    both = wanted.join(stored, ["home_id", "name"], "full_outer")
    tally = both.groupBy("home_id").agg(
        F.count_if(F.col("stored").isNull()).alias("n_missing"),
        F.count_if(F.col("wanted").isNull()).alias("n_extra"),
        F.count_if((F.col("name") == "meta") & F.col("stored")).alias("n_meta"),
    )
    judged = tally.join(sane(parsed).select("home_id", F.lit(True).alias("meta_ok")), "home_id", "left")
    reason = (
        F.when(F.col("n_meta") == 0, "meta_missing")
        .when(F.col("n_meta") > 1, "meta_repeated")
        .when(F.col("meta_ok").isNull(), "meta_invalid")
        .when(F.col("n_missing") > 0, "record_missing")
        .when(F.col("n_extra") > 0, "record_unreferenced")
        .otherwise("ok")
    )
    return judged.select("home_id", "n_missing", "n_extra", reason.alias("outcome"))


def merge(records: DataFrame) -> DataFrame:
    """Profiles as JSON text, for homes whose records are complete; never half a profile.

    A mergeable home has at most 1 + MAX_DEVICES + MAX_ROUTINES records, which bounds the lists.
    """
    whole = merge_audit(records).filter(F.col("outcome") == "ok").select("home_id")
    mine = records.join(whole, "home_id", "left_semi").join(
        metas(records).select("home_id", "device_refs"), "home_id"
    )
    ref = F.substring_index("name", ":", -1)
    place = F.when(kind() == "device", F.array_position("device_refs", ref)).when(
        kind() == "routine", ref.try_cast("int")
    )
    shaped = mine.select(
        "home_id",
        kind().alias("kind"),
        place.cast("int").alias("place"),
        ref.alias("ref"),
        F.when(kind() == "device", F.get_json_object("payload", "$._settings")).alias("settings"),
        F.when(
            kind() == "device",
            F.to_json(
                F.from_json(
                    "payload", "device_ref string, device_type string, capabilities array<string>"
                )
            ),
        )
        .when(kind() == "routine", F.col("payload"))
        .alias("body"),
    )

    def listed(which: str, cell):
        rows = F.collect_list(F.when(F.col("kind") == which, F.struct("place", cell.alias("cell"))))
        filled = F.filter(F.array_sort(rows), lambda r: r["cell"].isNotNull())
        return F.array_join(F.transform(filled, lambda r: r["cell"]), ",")

    setting = F.concat(F.lit('"'), F.col("ref"), F.lit('":'), F.col("settings"))
    profile = F.concat(
        F.lit(f'{{"schema_version":"{SCHEMA_VERSION}","devices":['), listed("device", F.col("body")),
        F.lit('],"settings":{'), listed("device", setting),
        F.lit('},"routines":['), listed("routine", F.col("body")),
        F.lit('],"reserved_wellness":{}}'),
    )
    return shaped.groupBy("home_id").agg(profile.alias("profile"))


# --- erase -------------------------------------------------------------------------------------


def erase_audit(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Is the erase request of a home accepted? One unknown name rejects all of it."""
    told = asked_and_live(records, requests).filter("asked")
    return told.groupBy("home_id").agg(
        F.count(F.lit(1)).alias("n_requested"),
        F.count_if(~F.col("live")).alias("n_unknown"),
        F.every("live").alias("accepted"),
    )


def asked_and_live(records: DataFrame, requests: DataFrame) -> DataFrame:
    """(home_id, name, asked, live): every name that is requested or stored, once; one grouping in place of a join.

    A request without a home or a name is not the request of a record that lacks them too.
    """
    known = F.col("home_id").isNotNull() & F.col("name").isNotNull()
    live = records.select("home_id", "name", F.lit(False).alias("asked"), known.alias("live"))
    asked = requests.select("home_id", "name", F.lit(True).alias("asked"), F.lit(False).alias("live"))
    return live.unionByName(asked).groupBy("home_id", "name").agg(F.some("asked").alias("asked"), F.some("live").alias("live"))


def erase(records: DataFrame, requests: DataFrame) -> DataFrame:
    """The store after all accepted requests."""
    refused = erase_audit(records, requests).filter("not accepted").select("home_id")
    gone = requests.select("home_id", "name").join(refused, "home_id", "left_anti")
    return records.join(gone, ["home_id", "name"], "left_anti")


def residue(revoked: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Records of revoked homes that still live after the erase.

    The names come from the meta record as it was before. Without a meta they cannot be known, and
    the residue is NULL, not 0.
    """
    mine = metas(before).join(revoked, "home_id", "left_semi")
    alive = after.select("home_id", "name").distinct()
    left = (
        expected_names(sane(mine))
        .join(alive.withColumn("alive", F.lit(True)), ["home_id", "name"], "left")
        .groupBy("home_id")
        .agg(F.count("alive").alias("residual_records"))
    )
    return revoked.select("home_id").join(left, "home_id", "left")
