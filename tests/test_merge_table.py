"""The keyed table merged on reading, zipped tensors, flat layouts and the summary files."""

import glob

import pytest
from pyspark.sql import functions as F

from cadenza.operators import motion as mo
from cadenza.sources import io
from cadenza.streaming import merge_table as mt

SCHEMA = "k long, v long, t string"


def rows_of(df):
    return {r.k: (r.v, r.t) for r in df.collect()}


def test_versions_equal_a_dictionary(spark, tmp_path):
    base, want = str(tmp_path / "table"), {}
    assert mt.read_table(spark, base) is None
    for n in range(9):
        rows = [((7 * i + n) % 40, (i * n) % 5 if i % 9 else None, f"{n}-{i}") for i in range(25)] + [(None, n % 4, f"{n}")]
        got = mt.merge_batch(spark.createDataFrame(rows, SCHEMA), n, base, "k", "v", fanout=3)
        low = lambda v: -1 if v is None else v
        own = {}
        for k, v, t in rows:
            if k not in own or (low(v), t) > (low(own[k][0]), own[k][1]):
                own[k] = (v, t)
        for k, (v, t) in own.items():
            if k not in want or low(v) >= low(want[k][0]):
                want[k] = (v, t)
        assert rows_of(mt.read_table(spark, base)) == want
        assert [r["level"] for r in got["runs"]] == [[0], [0, 0], [1], [1, 0], [1, 0, 0], [1, 1], [1, 1, 0], [1, 1, 0, 0], [2]][n]
    assert len(glob.glob(f"{base}/manifests/*.json")) == 2
    # a batch that is handed in again changes nothing
    mt.merge_batch(spark.createDataFrame([(1, 99, "again")], SCHEMA), 8, base, "k", "v", fanout=3)
    assert rows_of(mt.read_table(spark, base)) == want


def test_a_failed_batch_leaves_the_version_before_it(spark, tmp_path):
    base = str(tmp_path / "table")
    mt.merge_batch(spark.range(100).selectExpr("id AS k", "id AS v", "'a' AS t"), 0, base, "k", "v")
    broken = spark.range(50).selectExpr("id AS k", "id + 1 AS v", "CASE WHEN id = 49 THEN raise_error('lost') ELSE 'b' END AS t")
    with pytest.raises(Exception, match="lost"):
        mt.merge_batch(broken, 1, base, "k", "v")
    assert {t for _, t in rows_of(mt.read_table(spark, base)).values()} == {"a"}
    mt.merge_batch(broken.filter("k < 49"), 1, base, "k", "v")
    assert len(mt.live_bytes(spark, base)) == 2  # what the failed batch left is gone
    assert sum(t == "b" for _, t in rows_of(mt.read_table(spark, base)).values()) == 49


def test_a_batch_writes_its_own_rows(spark, tmp_path):
    base = str(tmp_path / "table")
    mt.merge_batch(spark.range(200_000).selectExpr("id AS k", "id AS v", "md5(string(id)) AS t"), 0, base, "k", "v")
    before = mt.live_bytes(spark, base)
    mt.merge_batch(spark.range(20).selectExpr("id * 9973 AS k", "id + 1000000 AS v", "md5(string(id)) AS t"), 1, base, "k", "v")
    added = {n: b for n, b in mt.live_bytes(spark, base).items() if n not in before}
    assert len(added) == 1 and sum(added.values()) < sum(before.values()) / 50
    mt.merge_batch(spark.createDataFrame([], SCHEMA), 2, base, "k", "v")
    assert mt.read_table(spark, base).count() == 200_000


def test_music_and_motion_side_by_side(spark):
    wide = lambda beat: [0.0, beat, 2.0]
    rows = [
        (1, [wide(0.0), wide(1.0)], [[5.0]]), (2, [wide(3.0)], [[1.0], [2.0]]), (3, [wide(0.0), [1.0]], [[1.0]]),
        (4, None, [[1.0]]), (5, [wide(0.0)], None), (6, [], []), (7, [None], [[1.0]]),
    ]
    nested = spark.createDataFrame(rows, "id long, music_array array<array<double>>, dance_array array<array<double>>")
    good, bad = io.zip_tensors(nested, "id", width=3, beat=1)
    got = sorted((r.id, r.frame, r.music and r.music[1], r.dance and r.dance[0], r.is_beat) for r in good.collect())
    assert got == [(1, 0, 0.0, 5.0, False), (1, 1, 1.0, None, True), (2, 0, 3.0, 1.0, True), (2, 1, None, 2.0, None)]
    reasons = dict(map(tuple, bad.collect()))
    assert reasons[3] == "music frame 1 of width 1" and reasons[4] == "no music" and reasons[5] == "no motion"
    assert set(reasons) == {3, 4, 5, 7}


def test_flat_layouts(spark):
    flat = lambda n: [float(i) for i in range(n)]
    rows = [(1, [flat(72), flat(72)]), (2, [flat(66)]), (3, [flat(72), flat(66)]), (4, [flat(75)]), (5, []), (6, None), (7, [None])]
    good, bad = mo.select_flat_layout(spark.createDataFrame(rows, "id long, f array<array<double>>"), "id", "f")
    assert good.groupBy("id").count().orderBy("id").collect() == [(1, 44), (2, 22)]
    assert good.filter("joint = 21 AND id = 2").select("x", "y", "z").first() == (63.0, 64.0, 65.0)
    assert dict(map(tuple, bad.collect())) == {
        3: "unexpected numbers per frame: 66..72", 4: "unexpected numbers per frame: 75..75", 5: "no frames", 6: "no frames",
        7: "unexpected numbers per frame: 0..0"}


def test_summary_files_begin_with_a_mark(spark, tmp_path):
    table = spark.createDataFrame([("é", 1)], "name string, total long")
    io.write_summary_csv(table, table, str(tmp_path), table.withColumn("x", F.lit(1)))
    for name in ("queries", "genres", "durations"):
        texts = [open(f, "rb").read() for f in glob.glob(f"{tmp_path}/{name}/*.csv")]
        assert any(t.startswith(b"\xef\xbb\xbfname,total") and "é,1".encode() in t for t in texts)
