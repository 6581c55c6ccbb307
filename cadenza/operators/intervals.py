"""Joins between points and half-open or closed intervals.

Spark has no interval join; a bare theta condition becomes a nested loop over the whole
key.  Here the axis is a binary hierarchy of cells: level ``k`` has cells of ``2 ** k`` times the finest width.  An
interval is stored in the largest aligned cells that make it up, at most two a level, so a very long one takes
``2 * log2(length)`` rows and not one for every finest cell.  A point asks one cell on every level that occurs, and meets
an interval over it in exactly one of them.  The cell in the join key also splits a hot sequence over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.sources.scratch import by_merge, checkpointed


def _shifted(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level)


def dyadic_cells(low: Column, high: Column) -> Column:
    """The disjoint cells ``struct<level, cell>`` that make up the whole numbers ``low .. high``; empty if there are none."""
    low, high = low.cast("bigint"), high.cast("bigint")
    levels = F.sequence(F.lit(0), F.ceil(F.log2((high - low + 2).cast("double"))).cast("int"))

    def of_level(k: Column) -> Column:
        first = _shifted(low + F.call_function("shiftleft", F.lit(1).cast("bigint"), k) - 1, k)
        end = _shifted(high + 1, k)
        cell = lambda at: F.struct(k.alias("level"), at.alias("cell"))
        odd = lambda c: c.bitwiseAND(F.lit(1).cast("bigint")) == 1
        return F.array(F.when((first < end) & odd(first), cell(first)), F.when((first < end) & odd(end), cell(end - 1)))

    return F.when(low <= high, F.array_compact(F.flatten(F.transform(levels, of_level))))


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: Column, low: Column, high: Column, condition: Column, width: float
) -> DataFrame:
    """Pairs of rows whose ``point`` lies in ``[low, high]`` and that meet ``condition``.

    ``low`` and ``high`` only steer the cells and may be wider than ``condition``; intervals with a null border or a low
    one above the high one, and null keys and points, meet nothing.  Runs jobs while it is built: the cells of the
    intervals are stored, as the levels that occur decide where points look.
    """
    at = lambda c: F.floor(c / width).cast("bigint")
    cells = F.when(low <= high, dyadic_cells(at(low), at(high)))
    held = by_merge(checkpointed(intervals.withColumn("_in", F.explode(cells))))
    # at most one number a level
    levels = sorted(r[0] for r in held.select("_in.level").distinct().collect())
    asked = F.array(*[F.struct(F.lit(k).alias("level"), _shifted(at(point), F.lit(k)).alias("cell")) for k in levels])
    left = points.withColumn("_in", F.explode(asked.cast("array<struct<level:int,cell:bigint>>")))
    l, r = left.alias("_l"), held.alias("_r")
    same = condition
    for k in [*keys, "_in"]:
        same = same & ((F.col(f"_l.{k}") == F.col(f"_r.{k}")) if k != "_in" else (
            (F.col("_l._in.level") == F.col("_r._in.level")) & (F.col("_l._in.cell") == F.col("_r._in.cell"))))
    keep = [F.col(f"_l.{c}") for c in points.columns]
    extra = [F.col(f"_r.{c}") for c in intervals.columns if c not in keys]
    return l.join(r, same).select(*keep, *extra)
