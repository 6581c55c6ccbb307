"""Caps, lists and alignments, with ties, nulls and empty tables."""

from pyspark.sql import functions as F

from cadenza.operators import curation, selection
from cadenza.operators import sequence as seq


def test_length_cap_reports_what_it_drops(spark):
    kept, report = selection.length_cap(spark.createDataFrame([(1, 5), (2, 70), (3, 71), (4, None)], "id long, n long"), "n", 70)
    assert sorted(r.id for r in kept.collect()) == [1, 2]
    assert sorted(map(tuple, report.collect())) == [("dropped", 2, 0.5), ("kept", 2, 0.5)]
    assert {r.n for r in selection.length_cap(kept.limit(0), "n", 70)[1].collect()} == {0}


def test_first_rows_of_each_group_without_dense_positions(spark):
    rows = spark.createDataFrame([(1, 10), (1, 30), (1, 20), (2, 7), (None, 1), (None, 2)], "k long, pos long")
    got = selection.cap_per_group(rows, ["k"], ["pos"], 2).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 10), (1, 20), (2, 7), (None, 1), (None, 2)], key=str)


def test_ignored_keys_and_nulls(spark):
    items = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "name string")
    bad = spark.createDataFrame([("b",), ("b",), (None,)], "name string")
    assert sorted((r.name for r in selection.ignore_list(items, bad, "name").collect()), key=str) == sorted(["a", "a", None], key=str)


def test_frames_of_seconds_take_even_ties(spark):
    row = spark.sql("SELECT 0.05D AS a, 1.0D / 60 * 5 AS b, 7L AS f").select(
        selection.seconds_to_frames(F.col("a")).alias("a"), selection.seconds_to_frames(F.col("b")).alias("b"),
        selection.rescale_frames(F.col("f"), 2, 16).alias("f")).first()
    assert tuple(row) == (2, 2, -2)


def test_all_rows_are_numbered_in_order_whatever_their_keys(spark):
    ids = [5, -3, 10**15, 7, 8, 2**62, 0] + list(range(1000, 1100))
    got = seq.number_all(spark.createDataFrame([(i,) for i in ids], "id long").repartition(5), ["id"], "n", start=1).collect()
    assert {r.id: r.n for r in got} == {i: n for n, i in enumerate(sorted(ids), 1)}
    scores = spark.createDataFrame([(i, round(i * 7919 % 1000 / 1000, 4)) for i in range(500)], "pos long, s double")
    ranked = curation.rank_by_score(scores, "s", "pos")
    want = sorted(((r.s, r.pos) for r in scores.collect()), key=lambda x: (-x[0], x[1]))
    assert [(r.s, r.pos) for r in ranked.orderBy("rank").collect()] == want
    assert seq.number_all(scores.limit(0), ["pos"], "n").count() == 0
