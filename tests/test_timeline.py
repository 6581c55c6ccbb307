"""Order-dependent operators against straightforward loops."""

import random

from pyspark.sql import functions as F

from cadenza.operators import timeline as tl


def unit_merge_loop(a):
    """Plain-Python statement of the rule: a run of one joins a neighbour, left to right."""
    starts = [i for i in range(len(a)) if i == 0 or a[i] != a[i - 1]]
    lens = lambda: [b - s for s, b in zip(starts, starts[1:] + [len(a)], strict=True)]
    i = 0
    while i < len(starts) and len(starts) > 1:
        size = lens()
        if size[i] > 1:
            i += 1
        elif i == 0:
            starts.pop(1)
        elif i == len(starts) - 1 or size[i - 1] <= size[i + 1]:
            starts.pop(i)
        else:
            starts.pop(i + 1)
    return starts


def test_unit_runs_join_a_neighbour(spark):
    rng = random.Random(3)
    cases = [[rng.randint(0, 3) for _ in range(rng.choice([1, 2, 5, 18]))] for _ in range(300)]
    for r in spark.createDataFrame([(a,) for a in cases], "a array<int>").select("a", tl.merge_unit_blocks(F.col("a")).alias("s")).collect():
        assert r.s == unit_merge_loop(r.a), r.a
    rows = [(0, i, v) for i, v in enumerate([1, 1, 2, 3, 3, 3, 4, 4, 5, 5, 5, 5, 6, 6, 7, 7, 8, 8])]
    df = spark.createDataFrame(rows, "clip bigint, frame bigint, label int")
    out = sorted(map(tuple, tl.slice_blocks(df, "clip", "frame", "label").select("start_frame", "end_frame").collect()))
    assert out[0] == (0, 25) and out[-1][1] == 150
    assert all(a[1] == b[0] for a, b in zip(out, out[1:], strict=False))
    # a short last slice keeps the scale: 6 of 18 labels are 50 of 150 frames
    longer = spark.createDataFrame(rows + [(0, 18 + i, v) for i, v in enumerate([1, 1, 1, 2, 2, 2])], df.schema)
    tail = tl.slice_blocks(longer, "clip", "frame", "label").filter("slice_idx = 1").orderBy("motion").collect()
    assert [(r.start_frame, r.end_frame) for r in tail] == [(0, 25), (25, 50)]
    left = tl.unstacked(longer, "clip", "frame", 5).collect()
    assert [(r.step, r.rows) for r in left] == [(4, 4)]


def greedy_loop(segs, short=10):
    """(start, end, slice, motion) walked frame by frame."""
    end, cur, out = max(s[1] for s in segs), 0, []
    while cur < end:
        exact = sorted((s for s in segs if s[0] == cur), key=lambda s: (s[2], s[3]))
        cover = sorted(s for s in segs if s[0] <= cur < s[1])
        later = sorted(s for s in segs if s[0] > cur)
        pick = exact[0] if exact else cover[-1] if cover else later[0]
        out.append([cur, pick[1], pick[2], pick[3]])
        cur = pick[1]
    merged = [out[0]]
    for s in out[1:]:
        if s[1] - s[0] < short:
            merged[-1][1] = s[1]
        else:
            merged.append(s)
    return [tuple(m) for m in merged]


def bar_loop(caps, ends):
    """Bar per caption (None when dropped), closing one bar per caption past its end."""
    cnt, out = 0, []
    for s, e in caps:
        if cnt >= len(ends):
            out.append(None)
        elif e / 30 <= ends[cnt]:
            out.append(cnt)
        elif s / 30 >= ends[cnt]:
            cnt += 1
            out.append(cnt if cnt < len(ends) else None)
        else:
            out.append(None)
    return out


def test_greedy_timeline_and_bars_match_loops(spark):
    rng = random.Random(11)
    videos, rows = {}, []
    for vid in range(6):
        segs = []
        for k in range(rng.randint(1, 9)):
            at = 0
            for m in range(rng.randint(1, 6)):
                size = rng.randint(1, 40)
                segs.append((at + 15 * k, at + size + 15 * k, k, m))
                at += size + rng.choice([0, 0, 12])
        videos[vid] = segs
        rows += [(vid, *s) for s in segs]
    df = spark.createDataFrame(rows, "base bigint, start_frame bigint, end_frame bigint, slice_idx bigint, motion bigint")
    got = tl.greedy_timeline(df, "base", chunk=64).collect()
    lines = {}
    for vid, segs in videos.items():
        mine = sorted((r.start_frame, r.end_frame, r.slice_idx, r.motion) for r in got if r.base == vid)
        assert mine == greedy_loop(segs), vid
        assert mine[0][0] == 0 and all(a[1] == b[0] for a, b in zip(mine, mine[1:], strict=False))
        lines[vid] = mine
    bars, ends = [], {}
    for vid, line in lines.items():
        cuts, t = [], 0.0
        while t < line[-1][1] / 30 * rng.choice([0.7, 1.1]):
            t = round(t + rng.choice([0.4, 1.0, 2.5]), 3)
            cuts.append(t)
        ends[vid] = cuts
        bars += [(vid, i, a, b) for i, (a, b) in enumerate(zip([0.0] + cuts, cuts, strict=False))]
    caps = spark.createDataFrame([(v, a, b) for v, ln in lines.items() for a, b, _, _ in ln], "base bigint, start_frame bigint, end_frame bigint")
    bdf = spark.createDataFrame(bars, "base bigint, bar bigint, start_sec double, end_sec double")
    out = tl.bar_bucketing(caps, bdf, "base").collect()
    for vid, line in lines.items():
        mine = [(r.bar if r.dropped == "" else None) for r in sorted((r for r in out if r.base == vid), key=lambda r: r.start_frame)]
        assert mine == bar_loop([(a, b) for a, b, _, _ in line], ends[vid]), vid


def test_windows_and_masks(spark):
    n = spark.createDataFrame([("a", 31), ("b", 5)], "k string, n bigint")
    assert [r.start for r in tl.training_windows(n, "n", 24, 8).orderBy("start").collect()] == [0]
    assert tl.sliding_slices(n, "n", 10, 5, 3).count() == 3
    masks = tl.masked_windows(n, "n", 24).orderBy("start").collect()
    assert len(masks) == 8 and sum(masks[0]["mask"]) == 22 and sum(masks[1]["mask"]) == 1 and masks[1]["mask"][-1] == 1


def test_tail_pad_always_adds_a_row(spark):
    n = spark.createDataFrame([("a", 8)], "k string, n bigint")
    f = spark.createDataFrame([("a", i, float(i)) for i in range(8)], "k string, frame bigint, x double")
    got = [r.x for r in tl.tail_pad(f, n, "k", "frame", "n", "x", 8, 2).orderBy("frame").collect()]
    assert got == [0.0, 0.0, *map(float, range(8)), *[7.0] * 8, 0.0, 0.0]


def test_segments_in_windows_right_bound_is_strict(spark):
    n = spark.createDataFrame([("a", 48)], "k string, n bigint")
    s = spark.createDataFrame([("a", 0, 0, 23), ("a", 1, 0, 24)], "k string, motion bigint, start_frame bigint, end_frame bigint")
    assert [r.motion for r in tl.segments_in_windows(s, n, "k", "n", 48, 8).collect()] == [0]


def test_upsample_and_ticks(spark):
    f = spark.createDataFrame([("a", i, float(i * i)) for i in range(5)], "k string, frame bigint, x double")
    up = [r.x for r in tl.upsample_2x(f, ["k"], "frame", ["x"], chunk=2).orderBy("frame").collect()]
    assert up == [0.0, 0.5, 1.0, 2.5, 4.0, 6.5, 9.0, 12.5, 16.0]
    g = spark.range(60).select(F.col("id").alias("frame"))
    assert [r.frame for r in tl.downsample_ticks(g, "frame", 60.0, 30.0).orderBy("frame").collect()] == list(range(0, 60, 2))


def test_systematic_sample_positions(spark):
    for total, size in ((10, 3), (100, 33), (7, 7), (13, 1)):
        df = spark.range(total).select(F.col("id").alias("pos"))
        got = sorted(r.pos for r in tl.systematic_sample(df, "pos", total, size).collect())
        assert got == [int(i * (total / size)) for i in range(size)]
