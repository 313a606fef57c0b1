"""Ordered windows that never put one long sequence into one task.

A plain ``Window.partitionBy(piece, part).orderBy(seq)`` sends a whole voice to a
single task. Here a sequence is cut into blocks of consecutive rows:

* ``running`` aggregates every block to one row, runs the prefix over those few
  rows, and adds the carried value to a window *inside* each block;
* ``halo`` copies the few rows next to a block edge into the neighbouring block,
  so ``lag`` and ``lead`` see across the edge.

Both shuffle on (keys, block). A block holds a bounded number of rows whatever
the length of the sequence, so a voice with a third of all notes is spread over
as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 17

_BLOCK = "__block"
_HOME = "__home"


def block_of(column: str, size: int = BLOCK_ROWS) -> Column:
    return F.expr(f"cast({column} div {int(size)} as bigint)")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column | None,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    nexts: dict[str, Column] | None = None,
    totals: dict[str, tuple[str, Column]] | None = None,
    keep_block: bool = False,
) -> DataFrame:
    """Add running values over each key's sequence; the row itself is excluded.

    ``sums``    sum over the earlier rows (0 on the first)
    ``lasts``   latest non-null value on an earlier row
    ``nexts``   first non-null value on a later row
    ``totals``  ("sum" | "max" | "min", column) over the whole key

    ``block`` must not decrease along ``order``; ``lasts`` and ``nexts`` need a
    single order column. ``keep_block`` leaves the block in the result; a pass
    that is given such rows and no ``block`` of its own runs on the same blocks
    without shuffling them again.
    """
    sums, lasts, nexts, totals = sums or {}, lasts or {}, nexts or {}, totals or {}
    if (lasts or nexts) and len(order) != 1:
        raise ValueError("lasts and nexts need a single order column")

    inputs = {**sums, **lasts, **nexts, **{name: col for name, (_, col) in totals.items()}}
    columns = [c for c in df.columns if c != _BLOCK]
    cut = F.col(_BLOCK) if block is None else block.alias(_BLOCK)
    work = df.select(*columns, cut, *[col.alias(f"__in_{name}") for name, col in inputs.items()])

    def given(name: str) -> Column:
        return F.col(f"__in_{name}")

    by = {"sum": F.sum, "max": F.max, "min": F.min}
    present = {name: F.when(given(name).isNotNull(), F.col(order[0])) for name in [*lasts, *nexts]}
    per_block = work.groupBy(*keys, _BLOCK).agg(
        *[F.sum(given(name)).alias(name) for name in sums],
        *[F.max_by(given(name), present[name]).alias(name) for name in lasts],
        *[F.min_by(given(name), present[name]).alias(name) for name in nexts],
        *[by[how](given(name)).alias(name) for name, (how, _) in totals.items()],
    )

    def frames(partition: list[str], order_cols: list) -> tuple:
        up = Window.partitionBy(*partition).orderBy(*[F.col(c).asc() for c in order_cols])
        down = Window.partitionBy(*partition).orderBy(*[F.col(c).desc() for c in order_cols])
        before = (Window.unboundedPreceding, -1)
        return up.rowsBetween(*before), down.rowsBetween(*before)

    earlier, later = frames(keys, [_BLOCK])
    whole = Window.partitionBy(*keys)
    carried = per_block.select(
        *keys,
        _BLOCK,
        *[F.sum(name).over(earlier).alias(f"__c_{name}") for name in sums],
        *[F.last(name, ignorenulls=True).over(earlier).alias(f"__c_{name}") for name in lasts],
        *[F.last(name, ignorenulls=True).over(later).alias(f"__c_{name}") for name in nexts],
        *[by[how](F.col(name)).over(whole).alias(f"__c_{name}") for name, (how, _) in totals.items()],
    )

    earlier, later = frames([*keys, _BLOCK], order)
    inside = work.select(
        *columns,
        _BLOCK,
        *[F.sum(given(name)).over(earlier).alias(f"__l_{name}") for name in sums],
        *[F.last(given(name), ignorenulls=True).over(earlier).alias(f"__l_{name}") for name in lasts],
        *[F.last(given(name), ignorenulls=True).over(later).alias(f"__l_{name}") for name in nexts],
    )
    return inside.join(carried, [*keys, _BLOCK]).select(
        *columns,
        *([_BLOCK] if keep_block else []),
        *[
            (F.coalesce(F.col(f"__l_{name}"), F.lit(0)) + F.coalesce(F.col(f"__c_{name}"), F.lit(0))).alias(name)
            for name in sums
        ],
        *[F.coalesce(F.col(f"__l_{name}"), F.col(f"__c_{name}")).alias(name) for name in [*lasts, *nexts]],
        *[F.col(f"__c_{name}").alias(name) for name in totals],
    )


def halo(df: DataFrame, index: str, before: int = 0, after: int = 0, size: int = BLOCK_ROWS) -> DataFrame:
    """Copy rows near a block edge into the next block over.

    ``index`` counts the rows of each key without gaps. Afterwards a window from
    ``neighbours`` sees ``before`` rows back and ``after`` rows ahead; ``settle``
    then drops the copies.
    """
    if max(before, after) >= size:
        raise ValueError("a block must be longer than the reach of the window")
    home = block_of(index, size)
    place = F.pmod(F.col(index), F.lit(size))
    head = (place < after) & (F.col(index) >= size)
    tail = place >= size - before
    targets = F.array(home)
    if after and before:
        targets = (
            F.when(head & tail, F.array(home - 1, home, home + 1))
            .when(head, F.array(home - 1, home))
            .when(tail, F.array(home, home + 1))
            .otherwise(targets)
        )
    elif after:
        targets = F.when(head, F.array(home - 1, home)).otherwise(targets)
    elif before:
        targets = F.when(tail, F.array(home, home + 1)).otherwise(targets)
    return df.select("*", home.alias(_HOME), F.explode(targets).alias(_BLOCK))


def neighbours(keys: list[str], index: str):
    return Window.partitionBy(*keys, _BLOCK).orderBy(index)


def settle(df: DataFrame, keep_block: bool = False) -> DataFrame:
    own = df.filter(F.col(_HOME) == F.col(_BLOCK)).drop(_HOME)
    return own if keep_block else own.drop(_BLOCK)
