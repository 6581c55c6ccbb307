"""Centred moments against numpy, far from the origin and over many tasks."""

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import evaluation as ev

SCHEMA = "g string, vec array<double>"


def frame(spark, rows):
    return spark.createDataFrame([(g, v.tolist()) for g, v in rows], SCHEMA).repartition(7)


def test_moments_of_shifted_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{i % 150}" if i % 3 else "hot", rng.normal(size=4) * [1, 2, 3, 0.1] + 1e8) for i in range(3000)] + [(None, np.full(4, 1e8)), ("g1", np.ones(3))]
    got = {r.g: r for r in ev.moments(frame(spark, rows), "g", "vec", 4).collect()}
    for g in {g for g, _ in rows}:
        x = np.array([v for k, v in rows if k == g and len(v) == 4]) - 1e8
        off = x - x.mean(axis=0)
        assert got[g].n == len(x)
        assert np.abs(np.array(got[g].mean) - 1e8 - x.mean(axis=0)).max() < 1e-6
        assert np.abs(np.array(got[g].m2).reshape(4, 4) - off.T @ off).max() < 1e-5
    assert ev.moments(frame(spark, rows).limit(0), "g", "vec", 4).count() == 0


def test_distance_does_not_depend_on_the_origin(spark):
    rng = np.random.default_rng(2)
    made, known = [("a", rng.normal(size=5)) for _ in range(400)], [("r", rng.normal(size=5) * 2 + 1) for _ in range(500)]
    far = lambda rows: frame(spark, [(g, v + 1e8) for g, v in rows])
    near = ev.frechet_distance(frame(spark, made), frame(spark, known), "g", "vec", 5).first().frechet
    assert abs(ev.frechet_distance(far(made), far(known), "g", "vec", 5).first().frechet - near) < 1e-6
    assert near > 1 and ev.frechet_distance(frame(spark, made).filter(F.lit(False)), frame(spark, known), "g", "vec", 5).count() == 0
