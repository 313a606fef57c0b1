"""Pattern keys, part lists, labels and span keys as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern_items(text: Column, comma_first: bool = False) -> Column:
    """Items of a pattern written with ``_`` or ``,`` (blank items dropped)."""
    splitter = F.when(text.contains(",") if comma_first else ~text.contains("_"), F.split(text, ",")).otherwise(
        F.split(text, "_")
    )
    return F.filter(F.transform(splitter, lambda x: F.trim(x)), lambda x: x != "")


def pattern_key(text: Column, comma_first: bool = False) -> Column:
    """The stable key of a pattern: its items joined by ``_``."""
    return F.array_join(pattern_items(text, comma_first), "_")


def part_labels(text: Column) -> Column:
    """Part labels named in a field such as ``1,2`` or ``2_1``, in given order."""
    return F.filter(F.transform(F.split(text, "::|[-,/_]"), lambda x: F.trim(x)), lambda x: x != "")


def score_label(title: Column, fallback: Column) -> Column:
    """The title, unless it is missing or ``Unknown``."""
    usable = F.when((title != "Unknown") & (title != ""), title)
    return F.coalesce(usable, fallback)


def trace_id(label: Column) -> Column:
    return F.replace(F.lower(label), F.lit(" "), F.lit("-"))


def location(value: Column) -> Column:
    """A user-given measure, beat or quarter position, comparable to a stored one."""
    return F.round(value, 5)


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def row_id(*parts: Column) -> Column:
    return F.concat_ws("::", *[p.cast("string") for p in parts])
