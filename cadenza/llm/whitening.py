"""Embedding whitening: leading components of the covariance by Jacobi-Davidson, without ever forming the covariance.

The data are touched by products alone: a pass over the stored vectors multiplies the centred rows by a thin block and
sums ``(x - mean)' (x - mean) B / n``.  Tasks return one thin block each, which Spark adds up.  All that the driver holds
has as many rows as a vector has entries and a few dozen columns, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import table
from cadenza.sources.scratch import checkpointed

COMPONENTS = 16
#: Vectors beside the wanted ones in the first block.
GUARDS = 4
#: Steps of the inner MINRES in every outer step.
INNER_STEPS = 5
#: Columns of the subspace before it restarts from its best vectors, in multiples of the first block.
SUBSPACE = 3
#: Outer steps at most; the loop ends before, once residuals stop falling at the rounding of the products.
OUTER_STEPS = 60
#: Entries are floor(SCALE * value) + SHIFT; larger ones than this would not be exact.
SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 52)
SEED = 13


@dataclass
class Whitening:
    """Integer moments of the fit list and its leading components; ``whitened = (x - sums / n) @ vectors / sqrt(values)``."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def quantised(vector: Column) -> Column:
    """``floor(64 c) + 1000000`` of every entry as a long array; null if the vector is null or empty or an entry has no such value."""
    doubles = F.transform(vector, lambda c: c.cast("double"))
    fits = F.forall(doubles, lambda c: F.coalesce(F.abs(c * SCALE) < LARGEST, F.lit(False)))
    exact = F.transform(doubles, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return F.when(fits & (F.size(vector) > 0), exact)


def _matrix(values: pa.ListArray, width: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _added(fit: DataFrame, rows: int, columns: int, of: str, work) -> np.ndarray:
    """The sum over all tasks of ``work(batch matrix)``, a ``rows x columns`` block."""
    width = rows if of == "entries" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x")
                part = work(_matrix(x, width or len(x[0])))
                total = part if total is None else total + part
        if total is not None:
            flat = total.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "v"])

    kind = "long" if of == "sums" else "double"
    summed = fit.select("x").mapInArrow(run, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(rows * columns, np.int64 if kind == "long" else float)
    out[summed["at"].to_numpy()] = summed["v"].to_numpy()
    return out.reshape(rows, columns)


class _Covariance:
    """Products with the covariance of the fit list, and nothing else of it."""

    def __init__(self, fit: DataFrame, n: int, sums: np.ndarray):
        self.fit, self.n, self.sums, self.products = fit, n, sums, 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def times(self, block: np.ndarray) -> np.ndarray:
        self.products += 1
        centred = self.centred
        return _added(self.fit, *block.shape, "entries", lambda x: (c := centred(x)).T @ (c @ block)) / self.n

    def __reduce__(self):
        # tasks need the moments only
        return _Covariance, (None, self.n, self.sums)


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the orthonormal columns ``against``."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
        q, r = np.linalg.qr(block)
        size = np.abs(np.diag(r))
        block = q[:, size > 1e-10 * max(size.max(initial=0.0), 1e-300)]
    block = block - against @ (against.T @ block)
    return np.linalg.qr(block)[0]


def _minres(apply, right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of symmetric systems, one a column; all columns take a step with one call of ``apply``."""
    k = right.shape[1]
    beta = np.linalg.norm(right, axis=0)
    safe = np.where(beta > 0, beta, 1.0)
    v_before, v = np.zeros_like(right), right / safe
    w_before, w = np.zeros_like(right), np.zeros_like(right)
    solution, eta = np.zeros_like(right), beta.copy()
    cosine, cosine_before, sine, sine_before = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    last = np.zeros(k)
    for _ in range(steps):
        u = apply(v)
        alpha = (v * u).sum(axis=0)
        u = u - alpha * v - last * v_before
        following = np.linalg.norm(u, axis=0)
        delta = cosine * alpha - cosine_before * sine * last
        rho_2 = sine * alpha + cosine_before * cosine * last
        rho_3 = sine_before * last
        rho = np.hypot(delta, following)
        going = (rho > 1e-300) & (beta > 0)
        rho = np.where(going, rho, 1.0)
        cosine_before, sine_before = cosine, sine
        cosine, sine = np.where(going, delta / rho, 1.0), np.where(going, following / rho, 0.0)
        w_next = (v - rho_3 * w_before - rho_2 * w) / rho
        solution = solution + np.where(going, cosine * eta, 0.0) * w_next
        eta = np.where(going, -sine * eta, 0.0)
        w_before, w = w, w_next
        v_before, v = v, u / np.where(following > 1e-300, following, 1.0)
        last = following
    return solution


def _leading(a: _Covariance, width: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of ``a``, their unit vectors and residual norms."""
    first = min(width, wanted + GUARDS)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, first)))[0]
    images = a.times(basis)
    locked, best, idle = 0, np.inf, 0
    for _ in range(OUTER_STEPS):
        # Rayleigh-Ritz in the whole subspace, locked vectors included: they stay its leading Ritz vectors
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        vectors, moved = basis @ turns, images @ turns
        residual = moved[:, :wanted] - vectors[:, :wanted] * values[:wanted]
        norms = np.linalg.norm(residual, axis=0)
        level = np.finfo(float).eps * max(values[0], 0.0) * np.sqrt(width)
        # pairs are locked from the top on, so that none below a missing one counts as found
        locked = int(np.argmin(np.append(norms <= level, False)))
        worst = norms.max()
        idle = idle + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if locked == wanted or basis.shape[1] == width or (idle >= 2 and worst < 1e3 * level):
            break
        if basis.shape[1] + wanted - locked > max(SUBSPACE * first, first + wanted):
            vectors, moved = vectors[:, :first], moved[:, :first]
        basis, images = vectors, moved
        # correction equations of all open pairs side by side, in the complement of the pairs found so far
        found, shifts = vectors[:, :wanted], values[locked:wanted]

        def projected(t: np.ndarray, found: np.ndarray = found, shifts: np.ndarray = shifts) -> np.ndarray:
            t = t - found @ (found.T @ t)
            t = a.times(t) - t * shifts
            return t - found @ (found.T @ t)

        right = -residual[:, locked:]
        corrections = _minres(projected, right - found @ (found.T @ right), INNER_STEPS)
        fresh = _orthonormal(corrections, basis)[:, : width - basis.shape[1]]
        if not fresh.shape[1]:
            break
        basis, images = np.hstack([basis, fresh]), np.hstack([images, a.times(fresh)])
    # the images were turned many times over: one fresh product settles values and residuals
    vectors = np.linalg.qr(vectors[:, : min(first, vectors.shape[1])])[0]
    images = a.times(vectors)
    small = vectors.T @ images
    values, turns = np.linalg.eigh((small + small.T) / 2)
    values, turns = values[::-1], turns[:, ::-1]
    vectors, images = (vectors @ turns)[:, :wanted], (images @ turns)[:, :wanted]
    return values[:wanted], vectors, np.linalg.norm(images - vectors * values[:wanted], axis=0)


def width_of(vectors: DataFrame) -> int:
    """The commonest length of the arrays ``x``, the longest of equally common ones; 0 without any."""
    sizes = vectors.filter(F.col("x").isNotNull()).groupBy(F.size("x").alias("d")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 0


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """Fit to the distinct arrays of length ``width`` in column ``x``; the model and the stored fit list.

    No vector gives no model.  Runs jobs while it is built: the moments, and one pass over the stored list a product.
    """
    listed = checkpointed(vectors.filter(F.size("x") == width).select("x").distinct())
    n = listed.count()
    if not n:
        return None, listed
    sums = _added(listed, 1, width, "sums", lambda x: x.sum(axis=0)).reshape(-1)
    a = _Covariance(listed, n, sums)
    centred = a.centred
    trace = float(_added(listed, 1, width, "squares", lambda x: (centred(x) ** 2).sum(axis=0)).sum()) / n
    values, found, residuals = _leading(a, width, min(components, width)) if trace > 0 else (
        np.zeros(min(components, width)), np.eye(width)[:, :components], np.zeros(min(components, width)))
    # a component without variance beyond rounding can't be scaled
    values = np.where(values > 1e-13 * trace, values, 0.0)
    return Whitening(n, sums, trace, values, found, residuals, a.products), listed


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    centred = (model.n * x - model.sums) / model.n
    return centred @ np.where(model.values > 0, model.vectors / np.sqrt(np.where(model.values > 0, model.values, 1.0)), np.nan)


def identity_error(listed: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, over components with variance."""
    live = int((model.values > 0).sum())
    if not live:
        return 0.0
    mean = _added(listed, 1, live, "mean", lambda x: _whitened(x, model)[:, :live].sum(axis=0)) / model.n

    def squares(x: np.ndarray) -> np.ndarray:
        w = _whitened(x, model)[:, :live] - mean
        return w.T @ w

    return float(np.abs(_added(listed, live, live, "covariance", squares) / model.n - np.eye(live)).max())


def _deviation(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sums of (n x - S)^2; null where one is beyond 64 bits."""
    off = model.n * x - model.sums
    if off.size and float(np.abs(off).max()) ** 2 * x.shape[1] >= 2.0**62:
        exact = [sum(v * v for v in row) for row in off.tolist()]
        return [e if e < 1 << 63 else None for e in exact]
    return (off * off).sum(axis=1).tolist()


def whiten(vectors: DataFrame, key: str, model: Whitening) -> DataFrame:
    """``key, component, deviation, whitened, explained`` for every row of ``vectors`` (``key``, long array ``x`` of the model's width)."""
    count = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), len(model.sums))
            white = _whitened(x, model).reshape(-1)
            each = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays([
                batch.column(key).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(_deviation(x, model), pa.int64()).take(pa.array(each)), pa.array(white, mask=np.isnan(white)),
                pa.array(np.tile(model.values / model.trace if model.trace > 0 else np.zeros(count), len(x))),
            ], [key, "component", "deviation", "whitened", "explained"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "x").mapInArrow(run, f"`{key}` {kind}, component int, deviation long, whitened double, explained double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every usable vector along the 16 leading components, or as many as a vector has entries.

    Rows with a null vector, null or non-finite entries, entries too large for an exact long, or another than the commonest
    length are dropped.  Repeated and null ids keep their rows; equal vectors count once in the fit.  A component without
    variance has null for ``whitened`` and 0 for ``explained``.  An empty table gives no row.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("x")).filter(F.col("x").isNotNull())
    width = width_of(rows)
    rows = rows.filter(F.size("x") == width)
    model, listed = fit(rows, width)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whiten(rows, "vec_id", model).select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(identity_error(listed, model)).alias("identity_error"))
