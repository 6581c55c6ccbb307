"""Ordered-sequence building blocks that do not put a whole sequence in one task.

A plain ``Window.partitionBy(seq)`` sends every row of a sequence to one task, so one
very long sequence decides the run time of the job.  The helpers here cut a sequence
into fixed-size chunks of its position column and work at two levels:

* inside a chunk with an ordinary window over ``(keys, chunk)``;
* across chunks on a summary with one row per ``(keys, chunk)``, which is ``chunk``
  times smaller than the data, joined back on ``(keys, chunk)``.

Bounded look-behind / look-ahead (``lag``, ``lead``, centred ROWS frames) needs no second
level: border rows are copied into the neighbouring chunk (``with_halo``).

Positions are non-negative integers and unique per key unless a helper says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cadenza.sources.scratch import by_merge, checkpointed

CHUNK = 4096

_CHUNK = "_chunk"
_OWN = "_own"


def chunk_index(pos: str | Column, chunk: int = CHUNK) -> Column:
    col = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(col / F.lit(chunk)).cast("bigint")


def with_halo(df: DataFrame, pos: str, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """Copy each row into every chunk whose rows look at it.

    A row at ``p`` is read by rows ``p - after .. p + before``.  Adds ``_chunk`` and
    ``_own`` (true on the copy in the row's home chunk).
    """
    p = F.col(pos)
    if before == 0 and after == 0:
        return df.withColumn(_CHUNK, chunk_index(p, chunk)).withColumn(_OWN, F.lit(True))
    first = F.greatest(chunk_index(p - F.lit(after), chunk), F.lit(0).cast("bigint"))
    last = chunk_index(p + F.lit(before), chunk)
    return df.withColumn(_CHUNK, F.explode(F.sequence(first, last))).withColumn(
        _OWN, F.col(_CHUNK) == chunk_index(p, chunk)
    )


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    exprs: Mapping[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    Positions must be dense (one row per integer) so that rows and positions agree.
    """
    w = Window.partitionBy(*keys, _CHUNK).orderBy(pos)
    halo = with_halo(df, pos, before, after, chunk)
    out = halo.select("*", *[fn(w).alias(name) for name, fn in exprs.items()])
    return out.filter(F.col(_OWN)).drop(_CHUNK, _OWN)


def _chunked(df: DataFrame, pos: str, chunk: int) -> DataFrame:
    return df.withColumn(_CHUNK, chunk_index(pos, chunk))


def _across(keys: Sequence[str]) -> WindowSpec:
    # one row per (keys, chunk): `chunk` times smaller than the data
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_CHUNK)


def _neighbour(
    df: DataFrame, keys: Sequence[str], pos: str, cols: Mapping[str, str | Column], ahead: bool, chunk: int
) -> DataFrame:
    packed = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])
    base = _chunked(df, pos, chunk).withColumn("_packed", packed)
    edge = F.min_by("_packed", pos) if ahead else F.max_by("_packed", pos)
    shift = F.lead if ahead else F.lag
    borders = (
        base.groupBy(*keys, _CHUNK)
        .agg(edge.alias("_edge"))
        .withColumn("_border", shift("_edge").over(_across(keys)))
        .select(*keys, _CHUNK, "_border")
    )
    w = Window.partitionBy(*keys, _CHUNK).orderBy(pos)
    joined = base.withColumn("_near", shift("_packed").over(w)).join(by_merge(borders), [*keys, _CHUNK])
    pick = F.coalesce("_near", "_border")
    return joined.withColumn("_pick", pick).select(
        *df.columns, *[F.col("_pick").getField(n).alias(n) for n in cols]
    )


def with_next(
    df: DataFrame, keys: Sequence[str], pos: str, cols: Mapping[str, str | Column], chunk: int = CHUNK
) -> DataFrame:
    """Columns of the following row of the sequence (positions may have gaps)."""
    return _neighbour(df, keys, pos, cols, True, chunk)


def with_previous(
    df: DataFrame, keys: Sequence[str], pos: str, cols: Mapping[str, str | Column], chunk: int = CHUNK
) -> DataFrame:
    """Columns of the preceding row of the sequence (positions may have gaps)."""
    return _neighbour(df, keys, pos, cols, False, chunk)


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str | Column,
    out: str,
    how: str = "sum",
    inclusive: bool = True,
    chunk: int = CHUNK,
) -> DataFrame:
    """Running ``sum`` or ``max`` from the start of the sequence; null before any value."""
    agg = {"sum": F.sum, "max": F.max}[how]
    v = F.col(value) if isinstance(value, str) else value
    base = _chunked(df, pos, chunk).withColumn("_v", v)
    carried = (
        base.groupBy(*keys, _CHUNK)
        .agg(agg("_v").alias("_total"))
        .withColumn(
            "_carry", agg("_total").over(_across(keys).rowsBetween(Window.unboundedPreceding, -1))
        )
        .select(*keys, _CHUNK, "_carry")
    )
    end = Window.currentRow if inclusive else -1
    w = Window.partitionBy(*keys, _CHUNK).orderBy(pos).rowsBetween(Window.unboundedPreceding, end)
    local = base.withColumn("_local", agg("_v").over(w)).join(by_merge(carried), [*keys, _CHUNK])
    if how == "sum":
        both = F.coalesce(F.col("_carry") + F.col("_local"), F.col("_carry"), F.col("_local"))
    else:
        both = F.greatest("_carry", "_local")
    return local.select(*df.columns, both.alias(out))


def fill(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str, ahead: bool, chunk: int = CHUNK
) -> DataFrame:
    """Nearest non-null ``value`` at or before (``ahead``: at or after) each row."""
    base = _chunked(df, pos, chunk)
    edge = F.min_by if ahead else F.max_by
    # min_by/max_by on a null ordering skips the row, so only rows holding a value count
    order = F.when(F.col(value).isNotNull(), F.col(pos))
    across = _across(keys)
    if ahead:
        span = across.rowsBetween(1, Window.unboundedFollowing)
        reach = F.first("_edge", ignorenulls=True).over(span)
        w = Window.partitionBy(*keys, _CHUNK).orderBy(pos).rowsBetween(0, Window.unboundedFollowing)
        near = F.first(value, ignorenulls=True).over(w)
    else:
        span = across.rowsBetween(Window.unboundedPreceding, -1)
        reach = F.last("_edge", ignorenulls=True).over(span)
        w = Window.partitionBy(*keys, _CHUNK).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        near = F.last(value, ignorenulls=True).over(w)
    carried = (
        base.groupBy(*keys, _CHUNK)
        .agg(edge(value, order).alias("_edge"))
        .withColumn("_reach", reach)
        .select(*keys, _CHUNK, "_reach")
    )
    joined = base.withColumn("_near", near).join(by_merge(carried), [*keys, _CHUNK])
    return joined.select(*df.columns, F.coalesce("_near", "_reach").alias(out))


def dense_position(
    df: DataFrame, keys: Sequence[str], coarse: Column, order: Sequence[str | Column], out: str, start: int = 0
) -> DataFrame:
    """``row_number`` per key in two levels.

    ``coarse`` must be monotone in ``order`` and cut a key into bounded groups (an hour of
    event time, a block of ids, ...).  Only the counts per ``(keys, coarse)`` are windowed
    over a whole key.
    """
    base = df.withColumn("_coarse", coarse)
    by_coarse = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_coarse")
    offsets = (
        base.groupBy(*keys, "_coarse")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(by_coarse.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(*keys, "_coarse", "_offset")
    )
    w = Window.partitionBy(*keys, "_coarse").orderBy(*order)
    joined = base.withColumn("_rn", F.row_number().over(w)).join(by_merge(offsets), [*keys, "_coarse"])
    number = (F.col("_offset") + F.col("_rn") - 1 + start).cast("bigint")
    return joined.select(*df.columns, number.alias(out))


def number_all(df: DataFrame, order: Sequence[str | Column], out: str, start: int = 0) -> DataFrame:
    """Number all rows of a table in a total order without bringing them together.

    Rows are dealt by ranges of the order and stored; the numbers of rows of the partitions, one row each,
    give every partition its offset.
    """
    sorted_rows = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    )
    placed = checkpointed(sorted_rows)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    number = (F.col("_offset") + F.col("_row") + start).cast("bigint")
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, number.alias(out))


def run_starts(df: DataFrame, keys: Sequence[str], pos: str, label: str, chunk: int = CHUNK) -> DataFrame:
    """Rows that open a run of equal labels."""
    flagged = windowed(df, keys, pos, {"_before": lambda w: F.lag(label).over(w)}, before=1, chunk=chunk)
    opens = (F.col(pos) == 0) | ~F.col("_before").eqNullSafe(F.col(label))
    return flagged.filter(opens).drop("_before")


def runs(
    df: DataFrame, keys: Sequence[str], pos: str, label: str, lengths: DataFrame, length: str, chunk: int = CHUNK
) -> DataFrame:
    """Runs of equal labels as ``start_frame``/``end_frame`` (end exclusive) with their ordinal ``motion``."""
    starts = run_starts(df, keys, pos, label, chunk).select(
        *keys, F.col(pos).cast("bigint").alias("start_frame"), F.col(label)
    )
    return close_segments(starts, keys, lengths, length, chunk)


def close_segments(
    starts: DataFrame, keys: Sequence[str], lengths: DataFrame, length: str, chunk: int = CHUNK
) -> DataFrame:
    """End each segment at the next start, the last one at the sequence length; number them."""
    closed = with_next(starts, keys, "start_frame", {"_next": "start_frame"}, chunk)
    numbered = dense_position(closed, keys, chunk_index("start_frame", chunk), ["start_frame"], "motion")
    return numbered.join(lengths.select(*keys, length), list(keys)).select(
        *starts.columns,
        F.coalesce("_next", length).cast("bigint").alias("end_frame"),
        "motion",
    )
