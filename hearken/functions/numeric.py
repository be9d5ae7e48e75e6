"""Number handling with the rounding and coercion rules of the feedback reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in a text cell; keeps Java-only spellings such as "1d" out.
NUMBER_SHAPE = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def round_even(value: Column, digits: int) -> Column:
    """Scale, round half to even on the binary value, scale back."""
    factor = F.lit(float(10**digits))
    return F.rint(value.cast("double") * factor) / factor


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """`part` as a percentage of `whole`; NULL when there is nothing to divide by."""
    ratio = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return round_even(ratio * F.lit(100.0), digits)


def to_number(cell: Column) -> Column:
    """Text or number to a finite double, anything else to NULL."""
    text = cell.cast("string")
    value = F.when(text.rlike(NUMBER_SHAPE), F.trim(text).try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def to_whole(cell: Column) -> Column:
    """Like `to_number`, but only whole values survive, as bigint."""
    value = to_number(cell)
    return F.when(F.floor(value) == value, value.try_cast("bigint"))
