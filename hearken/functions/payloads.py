"""Checks on landed JSON payloads, cheapest first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearken.functions.fixed_values import COMMAND_BUDGET, COMMAND_VERSION

BYTE_ORDER_MARK = "\ufeff"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is found once a row, however often `use` mentions it."""
    return F.transform(F.array(value), use)[0]


def as_text(payload: Column) -> Column:
    """UTF-8 bytes to text without a leading byte-order mark; broken bytes give NULL."""
    text = F.when(F.is_valid_utf8(payload), payload)
    return F.regexp_replace(text, "^" + BYTE_ORDER_MARK, "")


def trailing_text(text: Column) -> Column:
    """Is there anything after the outermost value closes?

    The text must be the only element of an array and the only member of an object. What follows a value can close one of
    the two brackets early, never both, so the parser decides at any depth and any length.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}")))
    longer = bound(listed, lambda v: v.isNull() | F.try_variant_get(v, "$[1]", "variant").isNotNull())
    return longer | member.isNull()


def reject_reason(payload: Column, max_bytes: int, version_path: str, version: str) -> Column:
    """The first reason to reject a payload, or 'accepted'.

    The size is checked before anything is parsed.
    """

    def judged(text: Column) -> Column:
        return (
            F.when(text.isNull(), "not_utf8")
            .when(F.get_json_object(text, "$").isNull(), "not_json")
            .when(F.try_parse_json(text).isNull(), "repeated_key")
            .when(~F.ltrim(text).startswith("{"), "not_an_object")
            .when(trailing_text(text), "trailing_text")
            .when(~F.get_json_object(text, version_path).eqNullSafe(F.lit(version)), "version")
            .otherwise("accepted")
        )

    return (
        F.when(payload.isNull(), "missing")
        .when(F.octet_length(payload) > max_bytes, "too_large")
        .otherwise(bound(as_text(payload), judged))
    )


def command_reason(payload: Column) -> Column:
    """Reject reason of a device command: payload rules, then its two required members."""
    text = as_text(payload)
    first = reject_reason(payload, COMMAND_BUDGET, "$.v", str(COMMAND_VERSION))
    shape = F.schema_of_variant(F.try_parse_json(F.get_json_object(text, "$.set")))
    ref = F.try_variant_get(F.try_parse_json(text), "$.device_ref", "variant")
    return (
        F.when(first != "accepted", first)
        .when(~F.schema_of_variant(ref).eqNullSafe("STRING"), "device_ref")
        .when(~F.coalesce(shape.startswith("OBJECT"), F.lit(False)), "set")
        .otherwise("accepted")
    )
