"""Many small k-means models at once: one for every sequence, all of them in the same rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.sources.scratch import checkpointed

#: Rows of a sequence that travel as one block, and parts of a sequence in which its starts are drawn first.
BLOCK_ROWS = 512
_SALTS = 64


def _starts(rows: DataFrame, key: str, order: list[str], vector: str, k: int, starts: int, seed: int) -> DataFrame:
    """``k`` rows of every sequence for every start, drawn by a hash of the row's place; fewer if it has fewer rows."""
    drawn = rows.select(key, vector, *order, F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start")).withColumn(
        "_h", F.xxhash64(F.lit(seed), "start", key, *order))
    near = Window.partitionBy(key, "start", F.pmod("_h", F.lit(_SALTS))).orderBy("_h", *order)
    whole = Window.partitionBy(key, "start").orderBy("_h", *order)
    few = drawn.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= k)
    first = few.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= k)
    listed = F.array_sort(F.collect_list(F.struct("_n", F.col(vector).alias("v"))))
    return first.groupBy(key, "start").agg(F.transform(listed, lambda r: r["v"]).alias("centroids"))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest nearest label and squared distance of every row."""
    d = ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    label = d.argmin(axis=1)
    return label, d[np.arange(len(x)), label]


def _matrix(rows) -> np.ndarray:
    return np.array([np.asarray(r, float) for r in rows])


def cluster_each(rows: DataFrame, key: str, order: list[str], vector: str, k: int = 5, starts: int = 10, max_iter: int = 300,
                 seed: int = 42, rest: float = 1e-9) -> DataFrame:
    """``key``, ``order``, ``label``: k-means of every sequence on its own, the cheapest of several starts (the first on ties).

    A round moves the centroids of all sequences and starts that have not come to rest: blocks of rows meet their
    sequence's centroids and return sums per label, which Spark adds up, so a sequence of any length is spread over its
    blocks.  A start rests when no centroid moves by more than ``rest`` of its size; an empty cluster keeps its centroid.
    Rows are unique in (``key``, ``order``); rows with a null vector or key are left out.
    Runs jobs while it is built, one a round.
    """
    kind = rows.schema[key].dataType.simpleString()
    usable = rows.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, *order, F.col(vector).cast("array<double>").alias("_v"))
    block = F.floor(F.monotonically_increasing_id() / BLOCK_ROWS)
    blocks = checkpointed(usable.withColumn("_block", block).groupBy(key, "_block").agg(
        F.collect_list("_v").alias("_rows"), F.collect_list(F.struct(*order)).alias("_places")))
    points = blocks.select(key, F.explode(F.arrays_zip("_rows", "_places")).alias("_p")).select(key, F.col("_p._rows").alias("_v"), "_p._places.*")
    state = checkpointed(_starts(points, key, order, "_v", k, starts, seed).withColumn("moved", F.lit(True)))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, start, held, centroids in batch[[key, "start", "_rows", "centroids"]].itertuples(index=False, name=None):
                x, c = _matrix(held), _matrix(centroids)
                label, cost = _nearest(x, c)
                for j in np.unique(label):
                    mine = label == j
                    out.append((name, start, int(j), [float(mine.sum()), float(cost[mine].sum()), *x[mine].sum(axis=0)]))
            yield pd.DataFrame(out, columns=[key, "start", "label", "sums"])

    def added(open_states: DataFrame) -> DataFrame:
        """Per sequence and start the labels with their row count, cost and vector sum."""
        parts = blocks.select(key, "_rows").join(open_states.select(key, "start", "centroids"), key).mapInPandas(
            sums, f"`{key}` {kind}, start int, label int, sums array<double>")
        cells = parts.select(key, "start", "label", F.posexplode("sums").alias("i", "v")).groupBy(key, "start", "label", "i").agg(F.sum("v").alias("v"))
        whole = cells.groupBy(key, "start", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("sums"))
        return whole.groupBy(key, "start").agg(F.map_from_entries(F.collect_list(F.struct("label", "sums"))).alias("found"))

    for _ in range(max_iter):
        going = state.filter("moved")
        if going.isEmpty():
            break
        mean = lambda c, j: F.coalesce(
            F.transform(F.slice(F.col("found")[j], 3, F.size(c)), lambda v: v / F.col("found")[j][0]), c)
        fresh = going.join(added(going), [key, "start"]).withColumn("_next", F.transform("centroids", mean))
        step = F.exists(F.arrays_zip(F.flatten("centroids").alias("a"), F.flatten("_next").alias("b")),
                        lambda p: F.abs(p["a"] - p["b"]) > rest * (1 + F.abs(p["a"])))
        state = checkpointed(state.filter("NOT moved").unionByName(
            fresh.select(key, "start", F.col("_next").alias("centroids"), step.alias("moved"))))
    cost = F.aggregate(F.map_values("found"), F.lit(0.0), lambda s, v: s + v[1])
    # costs that differ by rounding only count as equal
    costs = added(state).select(key, "start", F.round(cost, 9).alias("cost"))
    best = costs.groupBy(key).agg(F.min_by("start", F.struct("cost", "start")).alias("start")).join(state, [key, "start"]).select(key, "centroids")
    diff = lambda c: F.aggregate(F.zip_with("_v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    label = F.array_min(F.transform("centroids", lambda c, j: F.struct(diff(c).alias("d"), j.alias("j"))))["j"]
    return points.join(best, key).select(key, *order, label.cast("bigint").alias("label"))
