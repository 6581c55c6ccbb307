"""Whitening against dense eigenvalues in exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, component string"


def usable(rows):
    out = []
    for key, v, *_ in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            out.append((key, [math.floor(Fraction(float(np.float32(c))) * 64) + 1_000_000 for c in v]))
    return out


def check(got, rows, components=16):
    kept = usable(rows)
    listed = sorted({tuple(x) for _, x in kept})
    n, d = len(listed), len(listed[0])
    sums = [sum(c) for c in zip(*listed)]
    exact = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in listed])
    values, vectors = np.linalg.eigh(exact.T @ exact / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = (exact**2).sum() / n
    want, k = {}, min(components, d)
    for key, x in kept:
        off = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        want.setdefault(key, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums)), off @ vectors / np.sqrt(values)))
    assert len(got) == len(kept) * k and {g.component for g in got} == set(range(1, k + 1))
    signs = {}
    for g in got:
        assert g.n == n and g.identity_error < 1e-10
        assert abs(g.explained * trace / values[g.component - 1] - 1) < 1e-10
        at = g.component - 1
        fits = [w for dev, w in want[g.vec_id] if dev == g.deviation and abs(abs(w[at]) - abs(g.whitened)) < 1e-8]
        assert fits, (g, want[g.vec_id])
        if abs(g.whitened) > 1e-3 and len(want[g.vec_id]) == 1:
            signs.setdefault(at, set()).add(np.sign(g.whitened * fits[0][at]))
    assert all(len(s) == 1 for s in signs.values())


def test_given_vectors_against_a_dense_solver(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(whitening.op13_whitening(spark, SF).collect(), rows)


def written(spark, rows, tmp_path):
    spark.createDataFrame([(i, v, 0, "own", 1, "c") for i, v in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return whitening.op13_whitening(spark, str(tmp_path)).collect()


def test_bad_rows_copies_and_narrow_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(5) * [5, 3, 2, 1, 0.5]).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(7, rows[1][1]), (None, rows[2][1]), (None, rows[3][1])]
    bad = [(1, None), (2, []), (3, [1.0, None, 0.0, 0.0, 0.0]), (4, [float("nan")] * 5), (5, [float("inf")] + [0.0] * 4), (6, [1e30] * 5), (8, [1.0])]
    check(written(spark, rows + bad, tmp_path), [r for r in rows])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])]])
def test_nothing_to_fit(spark, tmp_path, rows):
    got = written(spark, rows, tmp_path)
    assert len(got) == 2 * sum(bool(v) for _, v in rows)
    assert all((g.n, g.deviation, g.whitened, g.explained, g.identity_error) == (1, 0, None, 0.0, 0.0) for g in got)


def test_wide_vectors_restart_and_lock(spark):
    """150 entries, steep and flat spectrum: the subspace never spans the whole space."""
    rng = np.random.default_rng(9)
    turn = np.linalg.qr(rng.standard_normal((150, 150)))[0]
    data = rng.standard_normal((2000, 150)) * (np.exp(-np.arange(150) / 20) * 9 + 0.3) @ turn
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "i long, v array<double>").select("i", whitening.quantised(F.col("v")).alias("x"))
    model, _ = whitening.fit(rows, 150)
    x = np.floor(data * 64)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.abs(model.values / values[::-1][:16] - 1).max() < 1e-12
    assert np.abs(np.abs((vectors[:, ::-1][:, :16] * model.vectors).sum(axis=0)) - 1).max() < 1e-12
    assert model.residuals.max() < 1e-12 * model.values[0] and model.products < 100


def test_deviations_are_exact_and_null_beyond_64_bits():
    model = whitening.Whitening(3_000_000_000, np.array([3_000_000_000 * 1_000_000, 0]), 1.0, np.ones(1), np.ones((2, 1)), np.zeros(1), 0)
    assert whitening._deviation(np.array([[1_000_001, 1], [1_000_000, 0], [1_000_002, 0]]), model) == [None, 0, None]
    small = whitening.Whitening(2**30, np.array([0]), 1.0, np.ones(1), np.ones((1, 1)), np.zeros(1), 0)
    assert whitening._deviation(np.array([[2], [1]]), small) == [2**62, 2**60]
