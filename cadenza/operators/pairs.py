"""Pairs inside buckets of any size, without a join that makes them all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket that one block holds; larger buckets are compared block by block.
BLOCK_ROWS = 1024

Finder = Callable[[pd.DataFrame, Iterator[tuple[np.ndarray, np.ndarray]]], pd.DataFrame]


def pairs_in_buckets(
    cells: DataFrame, key: str, row: str, find: Finder, schema: str, order: str | None = None, near: float = 0.0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Hand every pair of rows that share ``key`` to ``find``, once for each bucket they share.

    ``find(rows, pairs)`` gets whole blocks of buckets as a frame and an iterator over arrays of paired
    positions in it; it returns what it keeps, never all pairs.  With ``order``, only pairs whose values
    there differ by at most ``near`` are made.  A bucket with more than ``block_rows`` rows is cut into
    blocks by a hash of ``row``, and every two blocks meet in a task of their own: no task holds more than
    two blocks of one bucket, and no pair is left out.  Rows with a null key meet nobody.
    """
    sizes = cells.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    blocks = F.ceil(F.col("_n") / block_rows).cast("int")
    met = (
        cells.join(sizes, key)
        .withColumn("_mine", F.pmod(F.xxhash64(row), blocks).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("_lo", F.least("_mine", "_other")).withColumn("_hi", F.greatest("_mine", "_other"))
        .drop("_n", "_other")
    )
    sort = [key, "_lo", "_hi", *([order] if order else []), row]
    dealt = met.repartition(key, "_lo", "_hi").sortWithinPartitions(*sort)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_runs(batches, [key, "_lo", "_hi"]):
            yield find(rows, _pairs(rows, [key, "_lo", "_hi"], order, near))

    return dealt.mapInPandas(run, schema)


def _starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        v = rows[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def _whole_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    held: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        last = int(np.flatnonzero(_starts(rows, keys))[-1])
        if last:
            yield rows.iloc[:last].reset_index(drop=True)
        held = rows.iloc[last:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _pairs(rows: pd.DataFrame, keys: list[str], order: str | None, near: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    run = np.cumsum(_starts(rows, keys))
    mine, within = rows["_mine"].to_numpy(), (rows["_lo"] == rows["_hi"]).to_numpy()
    place = rows[order].to_numpy() if order else None
    left, step, n = np.arange(len(rows)), 0, len(rows)
    while len(left):
        step += 1
        left = left[left + step < n]
        left = left[run[left] == run[left + step]]
        if place is not None:
            left = left[place[left + step] - place[left] <= near]
        right = left + step
        meet = within[left] | (mine[left] != mine[right])
        if meet.any():
            yield left[meet], right[meet]
