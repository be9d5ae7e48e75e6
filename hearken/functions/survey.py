"""Expressions that code questionnaire answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearken.functions.fixed_values import NO_CHOICE


def leading_scale(answer: Column) -> Column:
    """The digit 1..5 an answer starts with, else NULL."""
    return F.regexp_extract(answer, r"(?U)^\s*([1-5])", 1).try_cast("int")


def has_keyword(answer: Column, keyword: str) -> Column:
    """1 when the answer contains the keyword, 0 otherwise and for no answer."""
    return F.coalesce(answer.contains(keyword), F.lit(False)).cast("int")


def picked_any(answer: Column, none: str = NO_CHOICE) -> Column:
    """1 when a comma-separated answer names anything but `none`."""
    options = F.split(F.coalesce(answer, F.lit("")), ",")
    return F.exists(options, lambda o: ~F.trim(o).isin("", none)).cast("int")


def coded(answer: Column, table: dict[str, float]) -> Column:
    """Code of an answer; an answer outside the table gives NULL."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), answer)
