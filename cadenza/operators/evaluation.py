"""Metrics over feature vectors, beats, codes, logs and experiments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ---- beats -----------------------------------------------------------------------------
def beat_alignment(nearest: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Mean ``exp(-d^2 / 18)`` per sequence, and the mean over sequences."""
    scored = nearest.filter(F.col("distance_sq").isNotNull())
    per = scored.groupBy(key).agg(F.avg(F.exp(-F.col("distance_sq") / 18.0)).alias("score"), F.count(F.lit(1)).alias("beats"))
    return per, per.agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("beats"))


# ---- feature vectors -------------------------------------------------------------------
def zscore_by_reference(features: DataFrame, reference: DataFrame, dim: str, value: str, eps: float | None = 1e-10) -> DataFrame:
    """Scale long-form features by the reference's mean and population deviation per dimension.

    ``eps`` is added to the deviation; ``None`` replaces deviations under 1e-6 by one instead.
    """
    # one row per dimension of a feature vector
    stats = F.broadcast(reference.groupBy(dim).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std")))
    scale = F.when(F.col("_std") < 1e-6, 1.0).otherwise(F.col("_std")) if eps is None else F.col("_std") + eps
    return features.join(stats, dim).select(
        *[((F.col(value) - F.col("_mean")) / scale).alias(value) if c == value else F.col(c) for c in features.columns]
    )


#: Groups whose moments a task keeps before it hands them on, and tasks' shares a group is first merged in.
_HELD_GROUPS = 64
_SHARES = 32


def _merged(parts: Sequence[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and centred sum of outer products of several sets from theirs; no large sums are subtracted."""
    n = np.array([p[0] for p in parts])
    means = np.stack([p[1] for p in parts])
    mean = means[0] + (n[:, None] * (means - means[0])).sum(axis=0) / n.sum()
    off = means - mean
    return float(n.sum()), mean, np.sum([p[2] for p in parts], axis=0) + (off * n[:, None]).T @ off


def _batch_moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict = {}

    def out() -> pd.DataFrame:
        return pd.DataFrame([(g, n, mean.tolist(), m2.ravel().tolist()) for g, (n, mean, m2) in held.items()], columns=["_g", "n", "mean", "m2"])

    for batch in batches:
        for name, part in batch.groupby("_g", sort=False, dropna=False):
            name = None if pd.isna(name) else name
            x = np.asarray(part["_vec"].tolist(), dtype=np.float64)
            mean = x[0] + (x - x[0]).mean(axis=0)
            own = (float(len(x)), mean, (x - mean).T @ (x - mean))
            held[name] = _merged([held[name], own]) if name in held else own
            if len(held) > _HELD_GROUPS:
                yield out()
                held.clear()
    yield out()


def _merge_rows(rows: pd.DataFrame) -> pd.DataFrame:
    d = len(rows["mean"].iloc[0])
    n, mean, m2 = _merged([(r.n, np.asarray(r.mean), np.asarray(r.m2).reshape(d, d)) for r in rows[["n", "mean", "m2"]].itertuples(index=False, name="R")])
    return pd.DataFrame({"_g": [rows["_g"].iloc[0]], "n": [n], "mean": [mean.tolist()], "m2": [m2.ravel().tolist()]})


def moments(features: DataFrame, group: str, vector: str, dims: int) -> DataFrame:
    """``(group, n, mean, m2)``: count, mean and flattened centred sum of outer products of vectors of ``dims`` entries.

    Every task hands on one set of moments for each group it meets (more if it meets many), so the traffic does not depend
    on the number of rows of a group.  Moments are merged centred, in two steps: shares of a group, then the group.
    """
    kind = "_g string, n double, mean array<double>, m2 array<double>"
    named = features.filter(F.size(vector) == dims).select(F.col(group).cast("string").alias("_g"), F.col(vector).alias("_vec"))
    share = F.pmod(F.monotonically_increasing_id(), F.lit(_SHARES))
    shares = named.mapInPandas(_batch_moments, kind).withColumn("_share", share).groupBy("_g", "_share").applyInPandas(_merge_rows, kind)
    return shares.groupBy("_g").applyInPandas(_merge_rows, kind).select(
        F.col("_g").alias(group), F.col("n").cast("bigint").alias("n"), "mean", "m2")


def _frechet(n1, m1, q1, n2, m2, q2) -> float:
    d = len(m1)
    c1, c2 = np.asarray(q1).reshape(d, d) / (n1 - 1), np.asarray(q2).reshape(d, d) / (n2 - 1)
    values = np.linalg.eigvals(c1 @ c2)
    if not np.isfinite(values).all():
        ridge = np.eye(d) * 1e-5
        values = np.linalg.eigvals((c1 + ridge) @ (c2 + ridge))
    root = np.sqrt(np.clip(values.real, 0.0, None)).sum()
    diff = np.asarray(m1) - np.asarray(m2)
    return float(diff @ diff + np.trace(c1) + np.trace(c2) - 2.0 * root)


@F.pandas_udf(T.DoubleType())
def _frechet_rows(n1: pd.Series, m1: pd.Series, q1: pd.Series, n2: pd.Series, m2: pd.Series, q2: pd.Series) -> pd.Series:
    return pd.Series([_frechet(*row) for row in zip(n1, m1, q1, n2, m2, q2, strict=True)])


def frechet_distance(generated: DataFrame, reference: DataFrame, group: str, vector: str, dims: int) -> DataFrame:
    """Fréchet distance of every generated group to the one reference set.

    Only centred moments of the groups reach the small matrix step, which also runs in tasks.
    """
    ref = moments(reference.withColumn("_all", F.lit("all")), "_all", vector, dims).select(
        F.col("n").alias("n2"), F.col("mean").alias("mean2"), F.col("m2").alias("q2")
    )
    gen = moments(generated, group, vector, dims).filter("n > 1")
    # the reference side is exactly one row
    both = gen.join(F.broadcast(ref))
    return both.select(group, "n", _frechet_rows("n", "mean", "m2", "n2", "mean2", "q2").alias("frechet"))


#: Rows of a block compared with the other block at once.
PAIR_ROWS = 128


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all of ``b`` by one product; where that cancels, from the differences."""
    centre = a.mean(axis=0)
    x, y = a - centre, b - centre
    norms = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)
    squares = norms - 2.0 * (x @ y.T)
    close = np.nonzero(squares <= 1e-6 * norms)
    for i in range(0, len(close[0]), 1 << 16):
        rows, cols = close[0][i : i + (1 << 16)], close[1][i : i + (1 << 16)]
        squares[rows, cols] = ((a[rows] - b[cols]) ** 2).sum(axis=1)
    return np.sqrt(squares)


def _pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    a = np.asarray(pdf.loc[pdf["_side"] == 0, "_vec"].tolist(), dtype=np.float64)
    b = np.asarray(pdf.loc[pdf["_side"] == 1, "_vec"].tolist(), dtype=np.float64)
    same = bool(pdf["_bi"].iloc[0] == pdf["_bj"].iloc[0])
    if same:
        b = a
    total = 0.0
    for start in range(0, len(a), PAIR_ROWS):
        tile = _distances(a[start : start + PAIR_ROWS], b[start:] if same else b)
        # of a block with itself every pair counts once: those right of the diagonal
        total += float(tile[:, : len(tile)][np.triu_indices(len(tile), 1)].sum() + tile[:, len(tile) :].sum()) if same else float(tile.sum())
    return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "total": [total]})


def mean_pairwise_distance(features: DataFrame, group: str, pos: str, vector: str, block: int = 512, grid: int = 64) -> DataFrame:
    """Mean distance over all pairs of a group.

    The sum needs every pair, but no pair becomes a row: vectors are dealt into blocks by a hash of their
    position, each task gets two blocks and returns one number.  A group has blocks of about ``block``
    vectors, ``grid`` blocks at most, so a vector is copied ``grid`` times at most however large the group.
    """
    base = features.select(F.col(group).cast("string").alias("_g"), F.col(pos).alias("_pos"), F.col(vector).alias("_vec"))
    count = base.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.least(F.lit(grid), F.ceil(F.col("n") / block)).cast("bigint")
    sized = base.join(count, "_g").select("_g", "_vec", (blocks - 1).alias("_top"), F.pmod(F.xxhash64("_pos"), blocks).alias("_b"))
    i = F.lit(0).cast("bigint")
    left = sized.select("_g", F.col("_b").alias("_bi"), F.explode(F.sequence("_b", "_top")).alias("_bj"), F.lit(0).alias("_side"), "_vec")
    right = sized.filter("_b > 0").select(
        "_g", F.explode(F.sequence(i, F.col("_b") - 1)).alias("_bi"), F.col("_b").alias("_bj"), F.lit(1).alias("_side"), "_vec"
    )
    sums = left.unionByName(right).groupBy("_g", "_bi", "_bj").applyInPandas(_pair_sums, "_g string, total double")
    total = sums.groupBy("_g").agg(F.sum("total").alias("_t"))
    n = F.col("n")
    return total.join(count, "_g").filter("n > 1").select(F.col("_g").alias(group), "n", (F.col("_t") / ((n * n - n) / 2)).alias("distance"))


# ---- codes, logs, experiments ----------------------------------------------------------
def code_histogram(codes: DataFrame, code: str, bins: int) -> DataFrame:
    """Use count of every code, zero bins included."""
    counts = codes.groupBy(F.col(code).cast("bigint").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return codes.sparkSession.range(bins).select(F.col("id").alias("code")).join(counts, "code", "left").select(
        "code", F.coalesce("n", F.lit(0)).alias("n")
    )


def loss_series(lines: DataFrame, line: str, order: str, threshold: float = float("inf")) -> DataFrame:
    """``updates[n]`` and ``loss[x]`` of log lines, the last line per iteration, clamped."""
    hits = lines.filter(F.contains(F.col(line), F.lit("update"))).select(
        order,
        F.regexp_extract(line, r"updates\[(\d+)\]", 1).cast("bigint").alias("iteration"),
        F.regexp_extract(line, r"loss\[([^\]]+)\]", 1).cast("double").alias("loss"),
    )
    return hits.groupBy("iteration").agg(F.least(F.max_by("loss", order), F.lit(threshold)).alias("loss"))


def mean_loss(rows: DataFrame, loss: str) -> DataFrame:
    mean = F.coalesce(F.avg(loss), F.lit(0.0))
    return rows.agg(mean.alias("mean_loss"), F.exp(mean).alias("perplexity"))


def experiment_board(finished: DataFrame, computed: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Append metrics of unfinished ``(experiment, epoch)`` pairs; failures stay as rows with their error."""
    keys = ["experiment", "epoch"]
    fresh = computed.join(finished.select(*keys).distinct(), keys, "left_anti")
    pivoted = lambda df: df.groupBy(*keys).pivot("metric", list(metrics)).agg(F.max("value"))
    errors = fresh.groupBy(*keys).agg(F.max("error").alias("error"))
    new = pivoted(fresh).join(errors, keys)
    old = finished.select(*keys, *metrics, "error")
    return old.unionByName(new.select(*old.columns))


def chart_series(board: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per experiment, epochs in order without failed ones."""
    epoch: Column = F.regexp_extract("epoch", r"(\d+)", 1).cast("bigint")
    return board.filter(F.col("error").isNull()).select("experiment", epoch.alias("epoch"), *metrics)
