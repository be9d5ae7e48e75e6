"""Expressions that look for identifiers in keys and values, and the redaction of values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hearken.functions.fixed_values import (
    EMAIL_SHAPE,
    IDENTIFIER_FRAGMENTS,
    IDENTIFIER_PHRASES,
    LOCATION_KEYS,
    MAX_VALUE_LENGTH,
    NATIONAL_ID_SHAPE,
    PHONE_SHAPE,
    WELLNESS_FRAGMENTS,
)
from hearken.functions.text import matches

NON_ASCII = r"[^\x00-\x7F]"
# Texts of ASCII and Hangul syllables only are their own NFKC form.
NOT_STABLE = r"[^\x00-\x7F\uAC00-\uD7A3]"
HIDDEN = r"[\p{Cf}\p{Cs}]"


def compatibility_form(text: Column) -> Column:
    """NFKC. Only text that may differ from it travels to Python."""

    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return F.coalesce(nfkc(F.when(text.rlike(NOT_STABLE), text)), text)


def any_fragment(text: Column, fragments: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for fragment in fragments:
        found = found | text.contains(fragment)
    return found


def value_rules(raw: Column, folded: Column) -> dict[str, Column]:
    """Rule -> broken? for a text value; `folded` is its compatibility form."""
    return {
        "hidden_characters": matches(raw, HIDDEN),
        "too_long": F.length(folded) > MAX_VALUE_LENGTH,
        "email": matches(folded, EMAIL_SHAPE),
        "phone": matches(folded, PHONE_SHAPE),
        "national_id": matches(folded, NATIONAL_ID_SHAPE),
        "identifier_phrase": any_fragment(folded, IDENTIFIER_PHRASES),
    }


def key_rules(raw: Column, folded: Column) -> dict[str, Column]:
    """Rule -> broken? for a key."""
    lowered = F.lower(folded)
    return {
        "key_hidden_characters": matches(raw, HIDDEN),
        "key_not_ascii": matches(folded, NON_ASCII),
        "key_identifier": any_fragment(lowered, IDENTIFIER_FRAGMENTS),
        "key_location": lowered.isin(list(LOCATION_KEYS)),
        "key_wellness": any_fragment(lowered, WELLNESS_FRAGMENTS),
    }


def redact(value: Column) -> Column:
    """Type, length and four hash digits in place of a value."""
    return F.concat(
        F.lit("<str len="),
        F.length(value).cast("string"),
        F.lit(" #"),
        F.substring(F.sha2(value, 256), 1, 4),
        F.lit(">"),
    )
