"""Interval joins against a nested loop, with intervals of any length."""

import random

from pyspark.sql import functions as F

from cadenza.operators.intervals import dyadic_cells, interval_join


def test_cells_cover_each_number_once_and_stay_few(spark):
    rng = random.Random(4)
    spans = [(a, a + rng.choice([0, 1, 2, 7, 63, 64, 65, 1000])) for a in (rng.randint(-3000, 3000) for _ in range(300))]
    spans += [(-5, 2**40), (0, 2**50 - 1), (-(2**40), 2**40), (3, 2), (None, 1), (1, None)]
    rows = spark.createDataFrame(spans, "a long, b long").withColumn("cells", dyadic_cells(F.col("a"), F.col("b"))).collect()
    for r in rows:
        if r.a is None or r.b is None or r.a > r.b:
            assert not r.cells
            continue
        ranges = sorted((c.cell << c.level, (c.cell + 1 << c.level) - 1) for c in r.cells)
        assert ranges[0][0] == r.a and ranges[-1][1] == r.b
        assert all(e + 1 == s for (_, e), (s, _) in zip(ranges, ranges[1:]))
        assert len(ranges) <= max(1, 2 * (r.b - r.a + 1).bit_length())


def test_join_equals_a_nested_loop(spark):
    rng = random.Random(8)
    points = [(rng.choice(["a", "b", None]), rng.choice([None, *[round(rng.uniform(-50, 50), 1)] * 30])) for _ in range(400)]
    spans = [(rng.choice(["a", "b", "c", None]), lo, lo + rng.choice([0.0, 0.3, 4.0, 30.0]), f"t{i}") for i, lo in
             enumerate(round(rng.uniform(-60, 60), 1) for _ in range(150))]
    spans += [("a", -(2.0**40), 2.0**45, "huge"), ("b", 5.0, 1.0, "upside down"), ("a", None, 3.0, "open"), ("a", 1.0, None, "open")]
    left = spark.createDataFrame(points, "k string, p double")
    right = spark.createDataFrame(spans, "k string, lo double, hi double, t string")
    inside = (F.col("lo") <= F.col("p")) & (F.col("p") < F.col("hi"))
    got = interval_join(left, right, ["k"], F.col("p"), F.col("lo"), F.col("hi"), inside, 0.5)
    assert got.columns == ["k", "p", "lo", "hi", "t"]
    want = [(k, p, lo, hi, t) for k, p in points for k2, lo, hi, t in spans
            if k is not None and k == k2 and None not in (p, lo, hi) and lo <= p < hi]
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(t == "huge" for *_, t in want)


def test_no_interval(spark):
    left = spark.createDataFrame([("a", 1)], "k string, p long")
    right = spark.createDataFrame([], "k string, lo long, hi long")
    assert interval_join(left, right, ["k"], F.col("p"), F.col("lo"), F.col("hi"), F.col("lo") <= F.col("p"), 4).collect() == []
