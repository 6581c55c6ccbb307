"""Chunked helpers give the same result as whole-sequence windows, whatever the chunk size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import sequence as seq


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    # one key holds most rows
    data = [("hot", i, rng.randint(0, 9), None if rng.random() < 0.8 else i) for i in range(300)]
    data += [(k, i, rng.randint(0, 9), None if i % 5 else i) for k in "ab" for i in range(23)]
    return spark.createDataFrame(data, "k string, p bigint, v bigint, s bigint").cache()


def collect(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_windowed_matches_plain_window(rows, chunk):
    w = Window.partitionBy("k").orderBy("p")
    want = rows.select("k", "p", F.lag("v", 2).over(w).alias("a"), F.min("v").over(w.rowsBetween(1, 3)).alias("b"))
    got = seq.windowed(
        rows.select("k", "p", "v"), ["k"], "p",
        {"a": lambda w: F.lag("v", 2).over(w), "b": lambda w: F.min("v").over(w.rowsBetween(1, 3))},
        before=2, after=3, chunk=chunk,
    )
    assert collect(got.select("k", "p", "a", "b")) == collect(want)


@pytest.mark.parametrize("how", ["sum", "max"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running(rows, how, inclusive):
    w = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.select("k", "p", {"sum": F.sum, "max": F.max}[how]("v").over(w).alias("r"))
    got = seq.running(rows, ["k"], "p", "v", "r", how, inclusive, chunk=7)
    assert collect(got.select("k", "p", "r")) == collect(want)


@pytest.mark.parametrize("ahead", [True, False])
def test_fill(rows, ahead):
    w = Window.partitionBy("k").orderBy("p")
    plain = (
        F.first("s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        if ahead else F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    got = seq.fill(rows, ["k"], "p", "s", "f", ahead, chunk=5)
    assert collect(got.select("k", "p", "f")) == collect(rows.select("k", "p", plain.alias("f")))


def test_neighbours_over_gaps(rows):
    sparse = rows.filter("v < 3").select("k", "p", "v")
    w = Window.partitionBy("k").orderBy("p")
    want = sparse.select("k", "p", F.lead("p").over(w).alias("n"), F.lag("v").over(w).alias("b"))
    nxt = seq.with_next(sparse, ["k"], "p", {"n": "p"}, chunk=6)
    both = seq.with_previous(nxt, ["k"], "p", {"b": "v"}, chunk=6)
    assert collect(both.select("k", "p", "n", "b")) == collect(want)


def test_dense_position_and_runs(rows):
    w = Window.partitionBy("k").orderBy("v", "p")
    want = rows.select("k", "p", (F.row_number().over(w) - 1).cast("bigint").alias("n"))
    assert collect(seq.dense_position(rows, ["k"], F.col("v"), ["v", "p"], "n").select("k", "p", "n")) == collect(want)
    lengths = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = seq.runs(rows.select("k", "p", "v"), ["k"], "p", "v", lengths, "n", chunk=4)
    values = {(r.k, r.p): r.v for r in rows.collect()}
    for k in ("hot", "a", "b"):
        segs = sorted((r for r in got.collect() if r.k == k), key=lambda r: r.motion)
        flat = [values[k, i] for i in range(len([1 for kk, _ in values if kk == k]))]
        cuts = [i for i in range(len(flat)) if i == 0 or flat[i] != flat[i - 1]]
        assert [s.start_frame for s in segs] == cuts
        assert [s.end_frame for s in segs] == cuts[1:] + [len(flat)]
        assert [s.motion for s in segs] == list(range(len(cuts)))
