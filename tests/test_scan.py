"""Segmented scans against a plain loop, with sequences over many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators.scan import Scan, following, previous, scan


def loop(rows, how, ahead, inclusive):
    """Values of v per row of (key, pos, v)."""
    out = {}
    groups = {}
    for k, p, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=ahead):
        groups.setdefault(k, []).append((p, v))
    for k, seq in groups.items():
        state = total = None
        for p, v in seq:
            before = state
            if how == "low":
                total = (total or 0) + (v or 0)
                state = total if state is None else min(state, total)
            elif v is not None:
                state = {"sum": lambda: (state or 0) + v, "max": lambda: v if state is None else max(state, v),
                         "min": lambda: v if state is None else min(state, v), "last": lambda: v}[how]()
            out[k, p] = state if inclusive else before
    return out


@pytest.fixture
def ranges(spark):
    """Many small ranges."""
    given = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13",
             "spark.sql.execution.arrow.maxRecordsPerBatch": "17"}
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",)}
    for k, v in given.items():
        spark.conf.set(k, v)
    yield spark
    for k in given:
        spark.conf.unset(k)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_all_scans_over_long_and_short_sequences(ranges):
    rng = random.Random(2)
    rows = [(1, p, rng.choice([None, rng.randint(-9, 9)])) for p in range(900)]
    rows += [(k, p * 3, rng.choice([None, rng.randint(-9, 9)])) for k in (None, *range(2, 40)) for p in range(rng.randint(1, 30))]
    rows += [(50, p, None) for p in range(200)]
    rng.shuffle(rows)
    df = ranges.createDataFrame(rows, "k int, p long, v int")
    kinds = [(h, a, i) for h in ("sum", "max", "min", "last", "low") for a in (False, True) for i in (False, True)]
    got = scan(df, ["k"], ["p"], {f"{h}{a:d}{i:d}": Scan(h, F.col("v"), a, i) for h, a, i in kinds}).collect()
    assert len(got) == len(rows)
    for h, a, i in kinds:
        want = loop(rows, h, a, i)
        assert {(r.k, r.p): r[f"{h}{a:d}{i:d}"] for r in got} == want, (h, a, i)


def test_neighbours_keep_nulls_and_any_type(ranges):
    rows = [("a" if p < 500 else None, p, None if p % 7 == 0 else f"t{p}") for p in range(600)]
    df = ranges.createDataFrame(rows, "k string, p long, t string")
    got = {r.p: (r.b, r.f) for r in scan(df, ["k"], ["p"], {"b": previous(F.col("t")), "f": following(F.col("t"))}).collect()}
    text = {p: t for _, p, t in rows}
    for p in range(600):
        b, f = got[p]
        assert (b is None) == (p in (0, 500)) and (f is None) == (p in (499, 599))
        assert (b is None or b.v == text[p - 1]) and (f is None or f.v == text[p + 1])


def test_doubles_empty_tables_and_one_exchange(ranges):
    df = ranges.createDataFrame([], "k int, p long, v double")
    assert scan(df, ["k"], ["p"], {"s": Scan("sum", F.col("v"))}).collect() == []
    rows = ranges.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("p"), (F.col("id") * 0.1).alias("v"))
    got = scan(rows, ["k"], ["p"], {"s": Scan("sum", F.col("v")), "m": Scan("max", F.col("v"), ahead=True)})
    assert max(abs(r.s - 0.1 * r.p * (r.p + 1) / 2) for r in got.collect()) < 1e-6 and {round(r.m, 6) for r in got.collect()} == {299.9}
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().toString()
