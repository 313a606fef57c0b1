"""Intervals and points that meet in aligned blocks of 1, 8, 64, 512 and 4096 units.

An interval of whole units is cut into the largest aligned blocks it holds: at most
14 of each size, and one for every 4096 units of a very long one. A point lies in one block of each
size, and in exactly one of any interval around it, so joining on the block gives every
(interval, point) once, without a row for each unit of the interval. The largest block bounds the rows
that share a join key.

``deep`` is the highest level in use, 0 to 4. Results do not depend on it; with 0 an interval has a row for each unit and a
point one row, which is best where intervals are short. ``depth`` reads it off the longest interval.
Blocks are numbered ``block * 8 + level``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 3
TOP = 4

_FIRST, _LAST = "__first", "__last"


def depth(intervals: DataFrame, units: Column) -> int:
    """The highest level worth using for intervals of so many ``units``; a job that brings one number."""
    longest = intervals.agg(F.max(units)).head()[0]
    return sum(longest >= 1 << BITS * level for level in range(1, TOP + 1)) if longest is not None else 0


def _inside(level: str, block: str) -> str:
    """Whether the interval holds the whole block."""
    return (
        f"(shiftleft({block}, {BITS} * ({level})) >= {_FIRST}"
        f" and shiftleft({block} + 1, {BITS} * ({level})) - 1 <= {_LAST})"
    )


def _range(start: str, end: str, level: int) -> str:
    """Numbers of the blocks from ``start`` up to ``end`` of one level."""
    return f"if({start} < {end}, sequence({start} * 8 + {level}, ({end} - 1) * 8 + {level}, 8L), array())"


def _cover(deep: int) -> str:
    """Numbers of the blocks that an interval is cut into."""
    if not deep:
        return f"sequence({_FIRST} * 8, {_LAST} * 8, 8L)"
    parts = []
    for level in range(deep + 1):
        start = f"(-shiftright(-{_FIRST}, {BITS * level}))"
        end = f"shiftright({_LAST} + 1, {BITS * level})"
        if level == deep:
            parts.append(_range(start, end, level))
            continue
        # The part that larger blocks cover is left out.
        above, below = f"(-shiftright(-{_FIRST}, {BITS * (level + 1)}))", f"shiftright({_LAST} + 1, {BITS * (level + 1)})"
        large = f"{above} < {below}"
        parts.append(_range(start, f"if({large}, {above} * 8, {end})", level))
        parts.append(f"if({large}, {_range(f'{below} * 8', end, level)}, array())")
    return f"concat({', '.join(parts)})"


def _above(deep: int) -> str:
    """Numbers of the blocks around the first unit, one of each size in use."""
    return f"array({', '.join(f'shiftright({_FIRST}, {BITS * level}) * 8 + {level}' for level in range(deep + 1))})"


def _units(df: DataFrame, first: Column, last: Column) -> DataFrame:
    return df.withColumns({_FIRST: first.cast("bigint"), _LAST: last.cast("bigint")})


def covered(intervals: DataFrame, first: Column, last: Column, deep: int = TOP) -> DataFrame:
    """Intervals with a row for each ``block`` that they are cut into; an interval that ends before it starts has none."""
    units = _units(intervals.filter(first <= last), first, last)
    return units.withColumn("block", F.explode(F.expr(_cover(deep)))).drop(_FIRST, _LAST)


def placed(points: DataFrame, at: Column, deep: int = TOP) -> DataFrame:
    """Points with a row for each ``block`` around unit ``at``."""
    units = _units(points, at, at)
    blocks = F.explode(F.expr(_above(deep))) if deep else F.col(_FIRST) * 8
    return units.withColumn("block", blocks).drop(_FIRST, _LAST)


def spread(intervals: DataFrame, first: Column, last: Column, deep: int = TOP) -> DataFrame:
    """Both of intervals whose starts are the points: ``covers`` and ``begins`` tell what each ``block`` is to its interval."""
    units = _units(intervals.filter(first <= last), first, last)
    level, block = "cast(block & 7 as int)", f"shiftright(block, {BITS})"
    codes, covers = _cover(deep), "true"
    if deep:
        codes = f"array_distinct(concat({_above(deep)}, {codes}))"
        larger = _inside(f"{level} + 1", f"shiftright({block}, {BITS})")
        covers = f"{_inside(level, block)} and ({level} = {deep} or not {larger})"
    begins = f"shiftright({_FIRST}, {BITS} * {level}) = {block}" if deep else f"block = {_FIRST} * 8"
    rows = units.withColumn("block", F.explode(F.expr(codes)))
    return rows.withColumns({"covers": F.expr(covers), "begins": F.expr(begins)}).drop(_FIRST, _LAST)


def meet(
    intervals: DataFrame, first: Column, last: Column, points: DataFrame, at: Column, keys: list[str], deep: int = TOP
) -> DataFrame:
    """Every interval with each point of its ``keys`` whose unit it covers, once."""
    return covered(intervals, first, last, deep).join(placed(points, at, deep), [*keys, "block"]).drop("block")
