"""The training loader against a loop over the sequences."""

from pyspark.sql import functions as F

from cadenza.plans import training

SCHEMES = {"strided": 3, "tumbling": 6, "every": 1}
FRAMES = "clip long, frame long, motion array<double>, music double"
SEGMENTS = "clip long, motion long, start_frame long, end_frame long"


def expected(frames, segments, interval, pad):
    out = {}
    by_clip = {}
    for clip, frame, motion, music in frames:
        if clip is not None:
            by_clip.setdefault(clip, {})[frame] = (motion, music)
    for clip, rows in by_clip.items():
        for scheme, move in SCHEMES.items():
            for i in rows:
                if i % move or any(i + o not in rows for o in range(interval)):
                    continue
                lo = i
                while lo - 1 in rows and lo > i - pad:
                    lo -= 1
                hi = i + interval
                while hi in rows and hi < i + interval + pad:
                    hi += 1
                context = [rows[p][0] if lo <= p < hi else [0.0, 0.0] for p in range(i - pad, i + interval + pad)]
                inside = sorted((2 * s, 2 * e, m) for c, m, s, e in segments if c == clip and 2 * s >= i and 2 * e < i + interval)
                mask = [1] * interval if move > 1 else [1] * (interval - 2) if i == 0 else [0] * (interval - 3) + [1]
                out[clip, scheme, i] = ([rows[i + o][0] for o in range(interval)], [rows[i + o][1] for o in range(interval)], context,
                                        [(m, s - i, e - i) for s, e, m in inside], mask)
    return out


def test_windows_match_loop(spark):
    frames = [(clip, f, [clip + f / 8, f / 4], f / 2) for clip, n in ((1, 40), (2, 6), (3, 5), (4, 23)) for f in range(n) if (clip, f) != (4, 13)]
    frames.append((None, 0, [0.0, 0.0], 0.0))
    segments = [(1, 0, 0, 1), (1, 1, 3, 5), (1, 2, 3, 5), (1, 3, 0, 18), (2, 0, 0, 2), (4, 0, 6, 7), (9, 0, 0, 1), (None, 0, 0, 1), (1, 4, 12, 14)]
    want = expected(frames, segments, 6, 2)
    for chunk in (1, 4, 7, 128):
        rows = training.window_records(
            spark.createDataFrame(frames, FRAMES), spark.createDataFrame(segments, SEGMENTS), "clip", 6, 2, 2, SCHEMES, chunk).collect()
        got = {(r.clip, r.scheme, r.start): (r.motion, r.music, r.context, [tuple(s) for s in r.segments], r["mask"]) for r in rows}
        assert len(got) == len(rows) and got == want, chunk
    assert (4, "every", 8) not in want and (4, "every", 7) in want and not any(k[0] == 3 for k in want)


def test_one_exchange_for_all_schemes(spark, tmp_path):
    frames, segments = spark.createDataFrame([], FRAMES), spark.createDataFrame([], SEGMENTS)
    records = training.window_records(frames, segments, "clip")
    assert records.collect() == []
    plan = records._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= 1


def test_sequences_need_text_and_music(spark):
    joints = [(c, f, j, float(c + f), float(j), 1.0) for c in (1, 2, 3) for f in range(4) for j in (0, 1)]
    joints.append((1, 9, 1, 0.0, 0.0, 0.0))
    music = [("mA0", f, float(f)) for f in range(3)] + [("mA0", 9, 9.0), ("mZ9", 0, 0.0)]
    names = [(1, "gA_x_y_z_mA0_ch01"), (2, "gA_x_y_z_mB0_ch01"), (3, "gA_x_y_z_mA0_ch01"), (3, "gB_x_y_z_mA0_ch02")]
    made = training.aligned_sequences(
        spark.createDataFrame(joints, "clip long, frame long, joint long, x double, y double, z double"),
        spark.createDataFrame(music, "music string, frame long, value double"),
        spark.createDataFrame(names, "clip long, name string"), spark.createDataFrame([(1,), (1,), (2,)], "clip long"), "clip", "name")
    got = {(r.clip, r.frame): (r.motion, r.music) for r in made.collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 9)}
    assert got[1, 2] == ([3.0, 0.0, 1.0, 0.0, 1.0, 0.0], 2.0)
    assert got[1, 9][0] == [None, None, None]
    assert made.filter(F.col("clip") == 3).count() == 0
