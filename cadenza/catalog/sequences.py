"""Runs, slices, windows and plans along a sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.catalog import views as vw
from cadenza.catalog.registry import half_up as hu
from cadenza.catalog.registry import query, rounded
from cadenza.operators import selection as sel
from cadenza.operators import sequence as seq
from cadenza.operators import timeline as tl

D = vw.DUCK
S = vw.SHARED


@query("sliding_slices", """
    SELECT clip, i AS slice_idx, 8 * i AS start, 8 * i + 20 AS "end"
    FROM (SELECT clip, n_frames, unnest(range(0, 6)) AS i FROM {lengths}) WHERE 8 * i + 20 <= n_frames""")
def sliding_slices(v):
    return tl.sliding_slices(v.lengths, "n_frames", 20, 8, 6).drop("n_frames")


D["label_runs"] = """
    SELECT clip, label, start_frame, coalesce(lead(start_frame) OVER w, n_frames) AS end_frame, row_number() OVER w - 1 AS motion
    FROM (SELECT clip, frame AS start_frame, label, lag(label) OVER (PARTITION BY clip ORDER BY frame) AS before FROM {frames})
    JOIN {lengths} USING (clip) WHERE before IS NULL OR before <> label WINDOW w AS (PARTITION BY clip ORDER BY start_frame)"""


@query("run_block_starts", "SELECT clip, motion, label, start_frame, end_frame FROM {label_runs}")
def run_block_starts(v):
    return seq.runs(v.labelled, ["clip"], "frame", "label", v.lengths, "n_frames")


@query("merge_unit_blocks")
def merge_unit_blocks(v):
    return tl.slice_blocks(v.labelled, "clip", "frame", "label")


@query("block_rescale_ends", """
    SELECT clip, slice_idx, motion, CAST(round_even(u * 150.0 / 18.0, 0) AS BIGINT) AS start_frame,
           lead(CAST(round_even(u * 150.0 / 18.0, 0) AS BIGINT), 1, 150) OVER (PARTITION BY clip, slice_idx ORDER BY u) AS end_frame
    FROM (SELECT clip, frame // 18 AS slice_idx, frame % 18 AS u,
                 row_number() OVER (PARTITION BY clip, frame // 18 ORDER BY frame) - 1 AS motion
          FROM {frames} JOIN {lengths} USING (clip) WHERE (frame // 18 + 1) * 18 <= n_frames AND (frame % 18 = 0 OR k < 40))""")
def block_rescale_ends(v):
    unit, group = F.col("frame") % 18, F.floor(F.col("frame") / 18).cast("bigint")
    starts = (
        v.frames.join(v.lengths, "clip").filter((group + 1) * 18 <= F.col("n_frames")).filter((unit == 0) | (F.col("k") < 40))
        .groupBy("clip", group.alias("slice_idx")).agg(F.array_sort(F.collect_list(unit)).alias("s"))
    )
    blocks = starts.select("clip", "slice_idx", F.posexplode(tl.rescale_blocks(F.col("s"))).alias("motion", "b"))
    return blocks.select("clip", "slice_idx", "motion", "b.*")


@query("nth_downbeat_segments", f"""
    SELECT clip, bar, {hu('start_sec')} AS start_sec, {hu('end_sec')} AS end_sec FROM {{bars}}""")
def nth_downbeat_segments(v):
    return rounded(bars(v), "start_sec", "end_sec")


D["bars"] = """
    SELECT clip, n // 4 AS bar, start_sec, lead(start_sec, 1, duration) OVER (PARTITION BY clip ORDER BY n) AS end_sec
    FROM (SELECT clip, n, CASE WHEN n = 0 THEN 0.0 ELSE t END AS start_sec
          FROM (SELECT clip, t, row_number() OVER (PARTITION BY clip ORDER BY t) - 1 AS n FROM {downbeats}) WHERE n % 4 = 0)
    JOIN {durations} USING (clip)"""


def bars(v):
    return tl.nth_downbeat_segments(v.downbeats, v.durations, "clip")


@query("linear_upsample_2x", f"""
    SELECT clip, 2 * frame AS frame, {hu('x')} AS x FROM {{frames}}
    UNION ALL SELECT clip, 2 * frame + 1, {hu('(x + nx) / 2')} FROM
        (SELECT clip, frame, x, lead(x) OVER (PARTITION BY clip ORDER BY frame) AS nx FROM {{frames}}) WHERE nx IS NOT NULL""")
def linear_upsample_2x(v):
    return rounded(tl.upsample_2x(v.frames.select("clip", "frame", "x"), ["clip"], "frame", ["x"]), "x")


@query("downsample", """
    SELECT clip, 'half' AS scheme, frame // 2 AS frame, x FROM {frames} WHERE frame % 2 = 0
    UNION ALL SELECT clip, 'ticks', CAST(floor((frame / 50.0 + 1e-9) * 30.0) AS BIGINT), x FROM {frames}
    WHERE frame = 0 OR floor((frame / 50.0 + 1e-9) * 30.0) > floor(((frame - 1) / 50.0 + 1e-9) * 30.0)""")
def downsample(v):
    f = v.frames.select("clip", "frame", "x")
    half = tl.downsample_half(f, "frame").select("clip", F.lit("half").alias("scheme"), "frame", "x")
    ticks = tl.downsample_ticks(f, "frame", 50.0, 30.0).select("clip", F.lit("ticks").alias("scheme"), F.col("tick").alias("frame"), "x")
    return half.unionByName(ticks)


@query("training_windows", f"""
    WITH w AS (SELECT clip, 'strided' AS scheme, unnest(range(0, n_frames - 24 + 1, 8)) AS start, 24 AS len FROM {{lengths}} WHERE n_frames >= 24
               UNION ALL SELECT clip, 'tumbling', unnest(range(0, n_frames - 24 + 1, 24)), 24 FROM {{lengths}} WHERE n_frames >= 24
               UNION ALL SELECT clip, 'every', unnest(range(0, n_frames - 24 + 1)), 24 FROM {{lengths}} WHERE n_frames >= 24)
    SELECT clip, scheme, start, CASE WHEN scheme <> 'every' THEN 24 WHEN start = 0 THEN 22 ELSE 1 END::BIGINT AS active, count(*) AS n, {hu('sum(x)', 4)} AS total
    FROM w JOIN {{frames}} f USING (clip) WHERE f.frame >= start AND f.frame < start + len GROUP BY ALL""")
def training_windows(v):
    f, n = v.frames.select("clip", "frame", "x"), v.lengths
    out = None
    for scheme, move in (("strided", 8), ("tumbling", 24), ("every", 1)):
        rows = tl.window_rows(f, n, "clip", "frame", "n_frames", 24, move)
        sums = rows.groupBy("clip", "start").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total"))
        if scheme == "every":
            mask = tl.masked_windows(n, "n_frames", 24).select(
                "clip", "start", F.aggregate("mask", F.lit(0), lambda a, b: a + b).alias("active"))
            sums = sums.join(mask, ["clip", "start"])
        else:
            sums = sums.withColumn("active", F.lit(24))
        part = sums.select("clip", F.lit(scheme).alias("scheme"), "start", "active", "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query("context_pad", """
    WITH w AS (SELECT clip, unnest(range(0, n_frames - 24 + 1, 12)) AS start FROM {lengths} WHERE n_frames >= 24),
         c AS (SELECT clip, start, unnest(range(24 + 10)) AS "offset" FROM w)
    SELECT clip, start, "offset", coalesce(x, 0.0) AS x FROM c LEFT JOIN {frames} f ON f.clip = c.clip AND f.frame = start + "offset" - 5""".replace("SELECT clip, start, \"offset\", coalesce", "SELECT c.clip, start, \"offset\", coalesce"))
def context_pad(v):
    return tl.context_pad(v.frames, v.lengths, "clip", "frame", "n_frames", "x", 24, 12, 5)


@query("tail_pad_multiple", """
    SELECT clip, frame + 3 AS frame, x FROM {frames}
    UNION ALL SELECT clip, p + 3, x FROM (SELECT clip, x, unnest(range(n_frames, (n_frames // 8 + 1) * 8)) AS p FROM {frames} JOIN {lengths} USING (clip) WHERE frame = n_frames - 1)
    UNION ALL SELECT clip, unnest(range(3)), 0.0 FROM {lengths}
    UNION ALL SELECT clip, unnest(range((n_frames // 8 + 1) * 8 + 3, (n_frames // 8 + 1) * 8 + 6)), 0.0 FROM {lengths}""")
def tail_pad_multiple(v):
    return tl.tail_pad(v.frames.select("clip", "frame", "x"), v.lengths, "clip", "frame", "n_frames", "x", 8, 3)


@query("velocity_integrate", f"""
    SELECT clip, frame, {hu('coalesce(sum(x) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)', 4)} AS position FROM {{frames}}""")
def velocity_integrate(v):
    out = tl.integrate_velocity(v.frames.select("clip", "frame", "x"), ["clip"], "frame", "x", "position")
    return rounded(out.drop("x"), "position", digits=4)


@query("uniform_clip_plan", f"""
    WITH p AS (SELECT item, d, greatest(0.0, d - 10.0) AS ms, least(3.0, greatest(0.0, d - 10.0)) AS lo
               FROM (SELECT l_orderkey * 10 + l_linenumber AS item, l_quantity AS d FROM {{lineitem}}))
    SELECT item, i AS clip_no, {hu('CASE WHEN one THEN lo ELSE lo + (ms - lo) * i / 4.0 END')} AS clip_start
    FROM (SELECT *, d <= 10.0 OR ms <= lo + 1e-6 AS one, unnest(range(CASE WHEN d <= 10.0 OR ms <= lo + 1e-6 THEN 1 ELSE 5 END)) AS i FROM p)""")
def uniform_clip_plan(v):
    media = v.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), "l_quantity")
    return rounded(tl.uniform_clip_plan(media, "l_quantity", 10.0, 5, 3.0).drop("l_quantity"), "clip_start")


@query("frame_sample_plan", f"""
    SELECT clip, frame, {hu('CASE WHEN d <= 2.0 THEN 0.0 WHEN d * 0.25 + 2.0 > d THEN d - 2.0 ELSE d * 0.25 END')} AS slice_start FROM (
        SELECT clip, n_frames / 30.0 AS d, unnest(range(9, least(n_frames, 9 + 6 * 7), 7)) AS frame FROM {{lengths}})""")
def frame_sample_plan(v):
    plan = tl.frame_sample_plan(v.lengths, "n_frames", 30.0, 0.25, 6, 0.3)
    start = tl.analysis_slice(F.col("n_frames") / 30.0, 2.0)
    return rounded(plan.select("clip", "frame", start.alias("slice_start")), "slice_start")


@query("time_to_index", f"""
    SELECT clip, {hu('t')} AS t, CAST(least(greatest(floor(t / duration * 144), 0), 143) AS BIGINT) AS frame_index
    FROM {{downbeats}} JOIN (SELECT clip, duration * 0.96 AS duration FROM {{durations}}) USING (clip) WHERE t <= duration + 1e-8""")
def time_to_index(v):
    trimmed = v.durations.withColumn("duration", F.col("duration") * 0.96)
    return rounded(tl.time_to_index(v.downbeats, trimmed, "clip"), "t")


@query("frame_stack", """
    SELECT clip, frame // 4 - 1 AS step, string_agg(CAST(k AS VARCHAR), ',' ORDER BY frame) AS k FROM {frames}
    GROUP BY clip, frame // 4 HAVING count(*) = 4 AND frame // 4 >= 1""")
def frame_stack(v):
    out = tl.frame_stack(v.frames.select("clip", "frame", "k"), "clip", "frame", "k", 4)
    return out.select("clip", "step", F.array_join("k", ",").alias("k"))


@query("segment_globalize", """
    SELECT base, slice_idx, motion, start_frame + 15 * slice_idx AS start_frame, end_frame + 15 * slice_idx AS end_frame,
           start_frame AS original_start, end_frame AS original_end, (start_frame + 15 * slice_idx) || ',' || (end_frame - 1 + 15 * slice_idx) AS key_frame
    FROM {slices} WHERE end_frame - start_frame >= 2""")
def segment_globalize(v):
    with_keys = v.slices.select("base", "slice_idx", "motion", "start_frame", "end_frame", F.array("start_frame", F.col("end_frame") - 1).alias("key_frame"))
    return tl.globalize(with_keys, 15, 2).withColumn("key_frame", F.array_join("key_frame", ","))


D["global_segments"] = """
    SELECT base, slice_idx, motion, start_frame + 15 * slice_idx AS start_frame, end_frame + 15 * slice_idx AS end_frame FROM {slices}"""
D["timeline"] = """
    WITH RECURSIVE nodes AS (SELECT DISTINCT base, CAST(0 AS BIGINT) AS pt FROM {global_segments} UNION SELECT DISTINCT base, end_frame FROM {global_segments}),
    ex AS (SELECT base, start_frame AS pt, arg_min({{'e': end_frame, 's': slice_idx, 'm': motion}}, {{'s': slice_idx, 'm': motion}}) AS b FROM {global_segments} GROUP BY ALL),
    cov AS (SELECT n.base, pt, arg_max({{'e': end_frame, 's': slice_idx, 'm': motion}}, {{'a': start_frame, 'e': end_frame, 's': slice_idx, 'm': motion}}) AS b
            FROM nodes n JOIN {global_segments} g ON g.base = n.base AND start_frame <= pt AND pt < end_frame GROUP BY ALL),
    nxt AS (SELECT n.base, pt, arg_min({{'e': end_frame, 's': slice_idx, 'm': motion}}, {{'a': start_frame, 'e': end_frame, 's': slice_idx, 'm': motion}}) AS b
            FROM nodes n JOIN {global_segments} g ON g.base = n.base AND start_frame > pt GROUP BY ALL),
    jump AS (SELECT base, pt, coalesce(ex.b, cov.b, nxt.b) AS b FROM nodes LEFT JOIN ex USING (base, pt) LEFT JOIN cov USING (base, pt) LEFT JOIN nxt USING (base, pt)),
    walk AS (SELECT base, pt, b.e AS e, b.s AS s, b.m AS m FROM jump WHERE pt = 0 AND b IS NOT NULL
             UNION ALL SELECT j.base, j.pt, j.b.e, j.b.s, j.b.m FROM walk w JOIN jump j ON j.base = w.base AND j.pt = w.e WHERE j.b IS NOT NULL)
    SELECT base, pt AS start_frame, coalesce(lead(pt) OVER (PARTITION BY base ORDER BY pt), stop) AS end_frame, s AS slice_idx, m AS motion
    FROM (SELECT base, pt, s, m, e, max(e) OVER (PARTITION BY base) AS stop FROM walk) WHERE pt = 0 OR e - pt >= 10""".replace("{{", "{").replace("}}", "}")


def global_segments(v):
    return tl.globalize(v.slices).select("base", "slice_idx", "motion", "start_frame", "end_frame")


@query("greedy_timeline_merge", "SELECT base, start_frame, end_frame, slice_idx, motion FROM {timeline}")
def greedy_timeline_merge(v):
    return tl.greedy_timeline(global_segments(v), "base")


@query("systematic_sample", """
    WITH n AS (SELECT count(*) AS total, greatest(1, CAST(floor(count(*) * 0.3) AS BIGINT)) AS size FROM {documents})
    SELECT doc_id FROM {documents} WHERE doc_id IN (SELECT CAST(floor(i * (total / size)) AS BIGINT) FROM (SELECT total, size, unnest(range(size)) AS i FROM n))""")
def systematic_sample(v):
    numbered = seq.number_all(v.documents.select("doc_id"), ["doc_id"], "pos")
    total = v.documents.count()
    return tl.systematic_sample(numbered, "pos", total, max(1, int(total * 0.3))).select("doc_id")


@query("cap_per_group", """
    SELECT clip, frame, x FROM {frames} QUALIFY row_number() OVER (PARTITION BY clip ORDER BY frame) <= 20""")
def cap_per_group(v):
    return sel.cap_per_group(v.frames.select("clip", "frame", "x"), ["clip"], ["frame"], 20)
