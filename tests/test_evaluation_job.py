"""The evaluation job against numpy."""

import numpy as np
import pytest

from cadenza.plans import evaluation


def frechet(a, b):
    root = np.sqrt(np.clip(np.linalg.eigvals(np.cov(a.T) @ np.cov(b.T)).real, 0, None)).sum()
    return ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(np.cov(a.T)) + np.trace(np.cov(b.T)) - 2 * root


def test_board_of_two_experiments(spark):
    rng = np.random.default_rng(8)
    width = {"kinetic": 3, "geometric": 2}
    known = {k: rng.normal(2, 3, (40, d)) for k, d in width.items()}
    made = {(e, p, k): rng.normal(1, 2, (n, d)) for e, p, n in (("a", "1", 12), ("a", "2", 9), ("b", "1", 1)) for k, d in width.items()}
    features = [(e, p, i, k, v.tolist()) for (e, p, k), m in made.items() for i, v in enumerate(m)] + [("old", "9", 0, "kinetic", [0.0] * 3)]
    reference = [(i, k, v.tolist()) for k, m in known.items() for i, v in enumerate(m)]
    board = evaluation.evaluate(
        spark.createDataFrame(features, "experiment string, epoch string, seq long, kind string, vector array<double>"),
        spark.createDataFrame(reference, "seq long, kind string, vector array<double>"),
        spark.createDataFrame([("old", "9", 1.0, 2.0, 3.0, 4.0, None)], "experiment string, epoch string, fid_k double, div_k double, fid_g double, div_g double, error string"),
        width,
    )
    got = {(r.experiment, r.epoch): r for r in board.collect()}
    assert set(got) == {("a", "1"), ("a", "2"), ("b", "1"), ("old", "9")} and got["old", "9"].div_g == 4.0
    assert got["b", "1"].error == "too few sequences for div_g, div_k, fid_g, fid_k" and got["b", "1"].fid_k is None
    for pair in (("a", "1"), ("a", "2")):
        for kind, s in evaluation.KINDS.items():
            scale = lambda m, k=kind: (m - known[k].mean(0)) / (known[k].std(0) + 1e-10)
            m, ref = scale(made[(*pair, kind)]), scale(known[kind])
            pairs = [np.linalg.norm(m[i] - m[j]) for i in range(len(m)) for j in range(i)]
            assert got[pair].error is None
            assert got[pair][f"fid_{s}"] == pytest.approx(frechet(m, ref), abs=1e-8)
            assert got[pair][f"div_{s}"] == pytest.approx(np.mean(pairs))
