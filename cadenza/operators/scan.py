"""Segmented scans: running values over very long sequences with one exchange.

Rows are dealt by ranges of (keys, order), so a sequence of any length lies in consecutive ranges and a range holds the
end of one sequence, whole ones, and the start of another.  Each task runs over its sorted rows once, keeps one state per
scan, and adds one row with its final states.  These rows, one or two a range, give what every range must add to the rows
of the sequence that began before it (or goes on after it); a projection adds it.  The input is read once, a row
is never joined with another row, and any number of scans in both directions share the pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.sources.scratch import checkpointed

_ROW, _FORWARD, _AHEAD = 0, 1, 2


@dataclass(frozen=True)
class Scan:
    """One running value.

    ``how``: ``sum``, ``max``, ``min`` of the non-null values so far, ``last`` non-null value, or ``low``, the least of all
    running sums so far.  Null before any value.  ``ahead`` runs from the end of the sequence to its start; ``inclusive``
    counts the row itself.
    """

    how: str
    value: Column
    ahead: bool = False
    inclusive: bool = True


def previous(value: Column) -> Scan:
    """The row before, null or not, as a struct ``v``; null on the first row."""
    return Scan("last", F.struct(value.alias("v")), inclusive=False)


def following(value: Column) -> Scan:
    """The row after, as a struct ``v``."""
    return Scan("last", F.struct(value.alias("v")), ahead=True, inclusive=False)


def _type_of(how: str, given: T.DataType) -> T.DataType:
    if how == "last":
        return given
    number = T.LongType() if isinstance(given, T.IntegralType | T.BooleanType) else T.DoubleType()
    return T.StructType([T.StructField("sum", number), T.StructField("low", number)]) if how == "low" else number


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], scans: Mapping[str, Scan]) -> DataFrame:
    """``df`` with one column per scan, over each sequence of equal ``keys`` (null is a key) in the ascending ``order``.

    The order should be total: rows equal in it come in any order, and lie in one range.  Runs jobs while it is built.
    """
    keys, order = list(keys), list(order)
    values = {name: s.value if s.how == "last" else s.value.cast(_numeric(df, s.value)) for name, s in scans.items()}
    base = df.select("*", *[v.alias(f"_scan_v_{n}") for n, v in values.items()])
    types = {n: _type_of(s.how, base.schema[f"_scan_v_{n}"].dataType) for n, s in scans.items()}
    rows = base.repartitionByRange(*keys, *order)
    columns = [*keys, *order]
    rows = rows.select("*", F.spark_partition_id().alias("_scan_range"), F.lit(_ROW).alias("_scan_state"))
    for mark, ahead in ((_FORWARD, False), (_AHEAD, True)):
        wanted = {n: s for n, s in scans.items() if s.ahead == ahead}
        if wanted:
            way = [F.col(c).desc_nulls_last() if ahead else F.col(c).asc_nulls_first() for c in columns]
            # the states of the other direction come first and pass
            sorted_rows = rows.sortWithinPartitions(F.col("_scan_state").desc(), *way)
            schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in {f"_scan_v_{n}" for n in wanted}]
                                  + [T.StructField(n, types[n]) for n in wanted])
            rows = sorted_rows.mapInArrow(_pass(keys, wanted, mark, [f.name for f in schema]), schema)
    placed = checkpointed(rows)
    out = placed.filter(F.col("_scan_state") == _ROW)
    for mark, ahead in ((_FORWARD, False), (_AHEAD, True)):
        wanted = {n: s for n, s in scans.items() if s.ahead == ahead}
        if wanted:
            out = _carried(placed, out, keys, wanted, types, mark)
    return out.select(*df.columns, *[F.col(n)["low"].alias(n) if s.how == "low" else F.col(n) for n, s in scans.items()])


def _numeric(df: DataFrame, value: Column) -> T.DataType:
    return _type_of("sum", df.select(value).schema[0].dataType)


# ---- inside a range -----------------------------------------------------------------------
def _pass(keys: list[str], scans: dict[str, Scan], mark: int, names: list[str]) -> Callable:
    hows = {n: (s.how, s.inclusive) for n, s in scans.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        states: dict[str, Any] = {}
        like: pa.RecordBatch | None = None
        for batch in batches:
            passing = pc.greater(batch.column("_scan_state"), _ROW)
            if batch.num_rows and passing[0].as_py():
                n = pc.sum(passing).as_py()
                yield _with_nulls(batch.slice(0, n), names, hows)
                batch = batch.slice(n)
            if not batch.num_rows:
                continue
            starts = _run_starts([batch.column(k) for k in keys], batch.num_rows)
            continues = tuple(batch.column(k)[0].as_py() for k in keys) == group
            made = {}
            for name, (how, inclusive) in hows.items():
                before = states.get(name) if continues else None
                made[name], states[name] = _RUNNERS[how](batch.column(f"_scan_v_{name}"), starts, before, inclusive)
            group = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
            like = pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names)
            yield like
        if like is not None:
            # one row with the states at the end of the range
            last = like.slice(like.num_rows - 1)
            given = {"_scan_state": pa.array([mark], pa.int32()), "_scan_range": last.column("_scan_range"), **{k: last.column(k) for k in keys},
                     **{n: states[n] if hows[n][0] == "last" else pa.array([states[n]], last.column(n).type) for n in hows}}
            yield pa.RecordBatch.from_arrays([given[n] if n in given else pa.nulls(1, last.column(n).type) for n in names], names)

    return run


def _with_nulls(batch: pa.RecordBatch, names: list[str], hows: dict) -> pa.RecordBatch:
    """Rows of states from the other direction, with nulls for this direction's scans."""
    def column(n: str) -> pa.Array:
        if n not in hows:
            return batch.column(n)
        given = batch.column(f"_scan_v_{n}").type
        return pa.nulls(batch.num_rows, pa.struct([("sum", given), ("low", given)]) if hows[n][0] == "low" else given)

    return pa.RecordBatch.from_arrays([column(n) for n in names], names)


def _run_starts(columns: list[pa.Array], n: int) -> np.ndarray:
    """For every row the place where its run of equal keys begins in the batch."""
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        codes = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


def _shifted(values: np.ndarray, known: np.ndarray, starts: np.ndarray, before: Any) -> tuple[np.ndarray, np.ndarray]:
    """The value one row earlier; at the start of the batch that of ``before``."""
    out, ok = np.empty_like(values), np.zeros(len(values), bool)
    out[1:], ok[1:] = values[:-1], known[:-1]
    opens = starts == np.arange(len(values))
    ok[opens], out[opens] = False, 0
    if before is not None:
        out[0], ok[0] = before, True
    return out, ok


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return pc.fill_null(column, pa.scalar(0, column.type)).to_numpy(zero_copy_only=False), known


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if values.dtype.kind == "i":
        total = np.cumsum(values)
        return total - (total - values)[starts]
    return pd.Series(values).groupby(starts).cumsum().to_numpy()


def _seen(known: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(known, np.arange(len(known)), -1)) >= starts


def _run_sum(column: pa.Array, starts: np.ndarray, before: Any, inclusive: bool) -> tuple[pa.Array, Any]:
    values, known = _numbers(column)
    total, seen = _sums(values, starts), _seen(known, starts)
    if before is not None:
        total, seen = np.where(starts == 0, total + before, total), seen | (starts == 0)
    return _number_result(total, seen, starts, before, inclusive, column.type)


def _run_extreme(largest: bool) -> Callable:
    def run(column: pa.Array, starts: np.ndarray, before: Any, inclusive: bool) -> tuple[pa.Array, Any]:
        values, known = _numbers(column)
        worst = np.iinfo(values.dtype) if values.dtype.kind == "i" else np.finfo(values.dtype)
        filled = pd.Series(np.where(known, values, worst.min if largest else worst.max)).groupby(starts)
        best = (filled.cummax() if largest else filled.cummin()).to_numpy()
        seen = _seen(known, starts)
        if before is not None:
            pick = np.maximum if largest else np.minimum
            best, seen = np.where(starts == 0, pick(best, before), best), seen | (starts == 0)
        return _number_result(best, seen, starts, before, inclusive, column.type)

    return run


def _number_result(values, known, starts, before, inclusive, kind) -> tuple[pa.Array, Any]:
    state = values[-1].item() if known[-1] else None
    if not inclusive:
        values, known = _shifted(values, known, starts, before)
    return pa.array(values, kind, mask=~known), state


def _run_low(column: pa.Array, starts: np.ndarray, before: Any, inclusive: bool) -> tuple[pa.Array, Any]:
    values, _ = _numbers(column)
    total = _sums(values, starts)
    if before is not None:
        total = np.where(starts == 0, total + before["sum"], total)
    low = pd.Series(total).groupby(starts).cummin().to_numpy()
    if before is not None:
        low = np.where(starts == 0, np.minimum(low, before["low"]), low)
    state = {"sum": total[-1].item(), "low": low[-1].item()}
    known = np.ones(len(total), bool)
    if not inclusive:
        low, _ = _shifted(low, known, starts, None if before is None else before["low"])
        total, known = _shifted(total, known, starts, None if before is None else before["sum"])
    fields = [pa.array(total, column.type), pa.array(low, column.type)]
    return pa.StructArray.from_arrays(fields, ["sum", "low"], mask=pa.array(~known)), state


def _run_last(column: pa.Array, starts: np.ndarray, before: pa.Array | None, inclusive: bool) -> tuple[pa.Array, pa.Array]:
    known = column.is_valid().to_numpy(zero_copy_only=False)
    n = len(known)
    at = np.maximum.accumulate(np.where(known, np.arange(n), -1))
    # place 0 holds what came before the batch, -1 stands for nothing
    at = np.where(at >= starts, at + 1, np.where((starts == 0) & (before is not None), 0, -1))
    state_at = at[-1]
    if not inclusive:
        opens = starts == np.arange(n)
        at = np.concatenate(([-1], at[:-1]))
        at[opens] = -1
        at[0] = 0 if before is not None else -1
    both = pa.concat_arrays([before if before is not None else pa.nulls(1, column.type), column])
    taken = both.take(pa.array(np.where(at < 0, 0, at), mask=at < 0))
    return taken, both.slice(max(state_at, 0), 1) if state_at >= 0 else pa.nulls(1, column.type)


_RUNNERS = {"sum": _run_sum, "max": _run_extreme(True), "min": _run_extreme(False), "low": _run_low, "last": _run_last}


# ---- between ranges -----------------------------------------------------------------------
def _both(how: str, earlier: Any, later: Any) -> Any:
    if earlier is None or later is None:
        return later if earlier is None else earlier
    if how == "low":
        return {"sum": earlier["sum"] + later["sum"], "low": min(earlier["low"], earlier["sum"] + later["low"])}
    return {"sum": lambda: earlier + later, "max": lambda: max(earlier, later), "min": lambda: min(earlier, later), "last": lambda: later}[how]()


def _combined(how: str, earlier: Column, later: Column) -> Column:
    if how == "low":
        both = F.struct((earlier["sum"] + later["sum"]).alias("sum"), F.least(earlier["low"], earlier["sum"] + later["low"]).alias("low"))
        return F.when(later.isNull(), earlier).when(earlier.isNull(), later).otherwise(both)
    if how == "sum":
        return F.coalesce(earlier + later, earlier, later)
    return {"max": F.greatest, "min": F.least}[how](earlier, later) if how != "last" else F.coalesce(later, earlier)


def _carried(placed: DataFrame, out: DataFrame, keys: list[str], scans: dict[str, Scan], types: dict, mark: int) -> DataFrame:
    """Add to the rows of the sequence that crosses into a range what the ranges before it (behind it, if ahead) hold of it."""
    states = placed.filter(F.col("_scan_state") == mark).select("_scan_range", *keys, *scans).collect()
    carries, held = [], None
    for s in sorted(states, key=lambda s: s["_scan_range"], reverse=mark == _AHEAD):
        if held is not None:
            carries.append((s["_scan_range"], *held))
        group, now = tuple(s[k] for k in keys), [s[n] for n in scans]
        if held is not None and held[0] == group:
            now = [_both(c.how, a, b) for c, a, b in zip(scans.values(), held[1], now)]
        held = (group, now)
    schema = T.StructType([
        T.StructField("_scan_range", T.IntegerType()), T.StructField("_scan_key", T.StructType([T.StructField(k, placed.schema[k].dataType) for k in keys])),
        T.StructField("_scan_carry", T.StructType([T.StructField(n, types[n]) for n in scans]))])
    # one row for each range
    given = F.broadcast(placed.sparkSession.createDataFrame(carries, schema))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_scan_key")[k])
    met = out.join(given, "_scan_range", "left").withColumn("_scan_same", F.coalesce(same & F.col("_scan_key").isNotNull(), F.lit(False)))
    final = {n: F.when(F.col("_scan_same"), _combined(s.how, F.col("_scan_carry")[n], F.col(n))).otherwise(F.col(n)) for n, s in scans.items()}
    return met.withColumns(final).drop("_scan_key", "_scan_carry", "_scan_same")
