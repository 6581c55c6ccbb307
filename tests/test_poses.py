import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cadenza.catalog import audio, motion
from cadenza.catalog.views import Views
from cadenza.operators import evaluation as ev
from cadenza.operators import motion as mo

SF = "/root/testdata/sf0.001"


def exchanged(df):
    """Rows of every exchange of the executed plan."""
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.startswith("ShuffleQueryStage"):
            return walk(node.plan())
        if name == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    df.collect()
    walk(plan)
    return found


def test_joints_and_bands_are_not_dealt_out(spark):
    v = Views(spark, SF)
    n = v.frames.count()
    for df in (mo.speed_envelope(v.poses, "clip"), mo.geometric_features(v.poses, "clip"), mo.to_19_points(v.poses, "clip"),
               mo.relative_to_root(v.poses, "clip"), mo.start_at_origin(v.poses, "clip"), audio.frame_bands(v)):
        assert sum(exchanged(df)) < 3 * n


def test_poses_give_what_joint_rows_give(spark):
    v = Views(spark, SF)
    few = v.frames.filter("clip < 3")
    poses = mo.Poses(few, v.poses.columns, v.poses.place, v.poses.count)
    rows = v.joints.filter("clip < 3")
    for op in (mo.speed_envelope, lambda j, k: mo.speed_envelope(j, k, mean=True, chunk=7), mo.relative_to_root, mo.relative_to_first_root,
               mo.start_at_origin, mo.to_19_points, mo.geometric_features):
        a, b = [op(j, "clip") for j in (poses, rows)]
        keys = [c for c in a.columns if c not in ("x", "y", "z", "speed", "value")]
        a, b = [df.select(*a.columns).toPandas().sort_values(keys).reset_index(drop=True) for df in (a, b)]
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-12)


def test_rows_are_not_sorted_to_choose_layouts(spark):
    plan = motion.joint_layout_select(Views(spark, SF))._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_distances_far_from_the_origin_and_of_copies():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 16)) + 1e5
    b = np.concatenate([rng.normal(size=(50, 16)) + 1e5, a[:9], a[:9] + 1e-7])
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert np.allclose(ev._distances(a, b), want, rtol=1e-7, atol=0)
    assert (ev._distances(a, b)[range(9), range(50, 59)] == 0).all()


def test_staged_files_grow_in_number(spark, tmp_path):
    from cadenza.catalog.streams import staged

    spark.range(40).repartition(23).write.parquet(str(tmp_path / "many"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        parts = spark.read.parquet(str(tmp_path / "many"))
        n = parts.rdd.getNumPartitions()
        assert n > 8
        view = type("V", (), {"spark": spark})
        stream = staged(view, parts.select("id", F.lit(1).alias("one")))
        assert stream.isStreaming
        folder = sorted(__import__("pathlib").Path(__import__("cadenza.sources.scratch", fromlist=["x"]).scratch_path(spark, "x")).parent.glob("incoming-*"), key=lambda p: p.stat().st_mtime)[-1]
        assert len(list(folder.glob("*.parquet"))) > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
