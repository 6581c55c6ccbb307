"""Cases that used to lose rows or change with the size: none may."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import texts
from cadenza.operators import captions, timeline, vectors
from cadenza.sources import io


def test_rounding_is_that_of_python(spark):
    rng = random.Random(3)
    values = [2.675, 0.12345, 0.5, 1.5, 2.5, -0.5, -2.675, 0.125, 1e-12, 1e17, 0.285, 1.005]
    values += [rng.uniform(-1000, 1000) for _ in range(5000)] + [rng.randrange(-10**6, 10**6) / 2 ** rng.randrange(1, 12) for _ in range(3000)]
    values += [rng.randrange(10**6) / 10**5 + 5e-5 for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select("v", *[texts.python_round(F.col("v"), d).alias(f"r{d}") for d in (0, 1, 2, 4, 6)]).collect()
    for r in got:
        assert [r[f"r{d}"] for d in (0, 1, 2, 4, 6)] == [round(r.v, d) for d in (0, 1, 2, 4, 6)]


@pytest.mark.parametrize("part_bytes", [1 << 26, 64])
def test_nearest_and_top_k_do_not_depend_on_the_size(spark, part_bytes):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=4).tolist()) for k in (1, 1, 2, 3, 3, 3)]
    centres = [(i, rng.normal(size=4).tolist()) for i in range(9)] + [(9, None)]
    centres[9] = (9, centres[0][1])  # a tie goes to the lower label
    frame = spark.createDataFrame(rows, "key long, v array<double>")
    got = vectors.assign_nearest(frame, spark.createDataFrame(centres, "label long, centroid array<double>"), "key", "v", part_bytes).collect()
    want = sorted((k, min((sum((np.array(v) - c) ** 2), i) for i, c in centres)[1]) for k, v in rows)
    assert sorted((r.key, r.label) for r in got) == want
    queries = spark.createDataFrame([(i, v) for i, v in centres[:5]], "query_id long, query_vector array<double>")
    top = vectors.top_k_per_query(queries, frame.distinct().withColumn("key", F.monotonically_increasing_id() + 100), "key", "v", 3, part_bytes=part_bytes)
    assert top.count() == 15 and top.select("query_id", "rank").distinct().count() == 15


def test_short_last_slices_stay(spark):
    rows = [(s, i, [float(i + 1), 1.0]) for s, n in ((0, 40), (1, 18), (2, 1)) for i in range(n)]
    got = vectors.cosine_context(spark.createDataFrame(rows, "seq long, pos long, v array<double>"), "seq", "pos", "v").collect()
    assert len(got) == 59 and {len(r.context) for r in got} == {19}
    tail = sorted((r.step, r.context) for r in got if r.seq == 0 and r.slice_idx == 2)
    assert len(tail) == 4 and tail[0][1][4:] == [0.0] * 15 and tail[3][1][18] == 1.0 and tail[1][1][1] == pytest.approx(1.0)


def test_clusters_keep_every_row_and_label_the_nearest_centroid(spark):
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.normal(c, 0.1, (30, 3)) for c in (0, 3, 6)])
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], "id long, f array<double>")
    labelled, centroids = vectors.cluster_frames(frame, "f", k=3)
    centres = {r.label: np.array(r.centroid) for r in centroids.collect()}
    rows = labelled.collect()
    assert len(rows) == 90
    for r in rows:
        assert r.label == min(centres, key=lambda c: np.sum((centres[c] - r.f) ** 2))
    for label, centre in centres.items():
        assert np.allclose(centre, np.mean([r.f for r in rows if r.label == label], axis=0))


def test_broken_arrays_are_told(spark, tmp_path):
    files = {"a_slice0.json": '[{"motion": 1, "name": "x"}, {"motion": null}]', "a_slice1.json": '[{"motion": 1}, {"mot', "a_slice2.json": '[{"motion": "one"}]',
             "a_slice3.json": '{"motion": 1}', "a_slice4.json": "[]"}
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    element = T.StructType().add("motion", "long").add("name", "string")
    rows, rejects = io.read_keyed_arrays_tolerant(spark, str(tmp_path), element)
    assert sorted(map(tuple, rows.collect())) == [("a", 0, 0, 1, "x"), ("a", 0, 1, None, None)]
    assert sorted((r.file[-6], r.reason) for r in rejects.collect()) == [
        ("1", "not a complete array"), ("2", "a value of another type"), ("3", "not a complete array")]
    with pytest.raises(PySparkException, match="not a JSON array"):
        io.read_keyed_arrays(spark, str(tmp_path), element).collect()


def test_all_movements_count_unless_limited(spark):
    parts = "".join(f"**{h}**: {h} text\n" for h in captions.BODY_PARTS.values())
    text = "".join(f"* **Movement {i} ({i}.0 - {i + 1}.0):**\n{parts}" for i in range(1, 10))
    frame = spark.createDataFrame([("k", text)], "k string, t string")
    assert [r.start_sec for r in captions.parse_movements(frame, ["k"], "t").orderBy("movement").collect()] == [float(i) for i in range(1, 10)]
    some = captions.parse_movements(frame, ["k"], "t", captions.MAX_MOVEMENTS).collect()
    assert len(some) == 7 and {r.cut for r in some} == {2}


def test_segments_without_frames_do_not_end_a_timeline(spark):
    rows = [("v", 0, 0, 0, 50), ("v", 0, 1, 50, 50), ("v", 0, 2, 50, 90)]
    got = timeline.greedy_timeline(spark.createDataFrame(rows, "video string, slice_idx long, motion long, start_frame long, end_frame long"), "video")
    assert sorted((r.start_frame, r.end_frame) for r in got.collect()) == [(0, 50), (50, 90)]
