"""Interval, nearest, positional and list joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.catalog import views as vw
from cadenza.catalog.registry import half_up as hu
from cadenza.catalog.registry import query, rounded
from cadenza.catalog.sequences import bars, global_segments
from cadenza.operators import selection as sel
from cadenza.operators import motion as mo
from cadenza.operators import names
from cadenza.operators import sequence as seq
from cadenza.operators import timeline as tl
from cadenza.operators import titles

D = vw.DUCK
S = vw.SHARED

S["turn_pairs"] = """
    SELECT a.conv_id AS file, a.turn AS motion, a.text AS caption, b.text AS modifier
    FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""


@query("positional_interleave", """
    WITH p AS (SELECT file, motion, string_split(caption, '.') AS a, string_split(modifier, '.') AS b FROM {turn_pairs})
    SELECT file, motion, string_agg(s, '|' ORDER BY i) AS modifier, count(*) AS n FROM (
        SELECT file, motion, 2 * i AS i, unnest(a) AS s FROM (SELECT file, motion, a, unnest(range(1, len(a) + 1)) AS i FROM p) q(file, motion, z, i), (SELECT 1) WHERE FALSE
        UNION ALL SELECT file, motion, 2 * i, a[i] FROM (SELECT file, motion, a, unnest(range(1, len(a) + 1)) AS i FROM p)
        UNION ALL SELECT file, motion, 2 * i + 1, b[i] FROM (SELECT file, motion, b, unnest(range(1, len(b) + 1)) AS i FROM p)) GROUP BY ALL""".replace("""SELECT file, motion, 2 * i AS i, unnest(a) AS s FROM (SELECT file, motion, a, unnest(range(1, len(a) + 1)) AS i FROM p) q(file, motion, z, i), (SELECT 1) WHERE FALSE
        UNION ALL SELECT file, motion, 2 * i, a[i]""", "SELECT file, motion, 2 * i AS i, a[i] AS s"))
def positional_interleave(v):
    from cadenza.operators import captions as cp

    pairs = v.turn_pairs
    a = pairs.select("file", "motion", F.split("caption", r"\.").alias("items"))
    b = pairs.select("file", "motion", F.split("modifier", r"\.").alias("items"))
    out = cp.interleave(a, b, ["file", "motion"], "items")
    return out.select("file", "motion", F.array_join("items", "|").alias("modifier"), F.size("items").alias("n"))


S["cue_rows"] = "SELECT conv_id AS file, turn AS motion, text FROM {conversations} WHERE role = 'user'"


@query("annotation_lookup", """
    SELECT c.file, c.motion, coalesce(len(string_split(q.text, ' ')), 0) AS cues, coalesce(q.text, '') AS cue,
           coalesce(r.text, 'Error: No response') AS response
    FROM (SELECT conv_id AS file, turn AS motion FROM {conversations}) c
    LEFT JOIN {cue_rows} q ON q.file = c.file AND q.motion = c.motion
    LEFT JOIN {captions} r ON r.file = c.file AND r.motion = c.motion""")
def annotation_lookup(v):
    from cadenza.operators import captions as cp

    segments = v.conversations.select(F.col("conv_id").alias("file"), F.col("turn").alias("motion"))
    extra = v.cue_rows.select("file", "motion", F.split("text", " ").alias("cues"))
    responses = v.captions.select("file", "motion", F.col("text").alias("response"))
    out = cp.annotation_lookup(segments, extra, responses, ["file", "motion"], "cues", "response")
    return out.select("file", "motion", F.size("cues").alias("cues"), F.array_join("cues", " ").alias("cue"), "response")


@query("modality_inner", """
    SELECT n.item, n.name, CAST(l.quality AS BIGINT) AS quality, m.plays FROM {seq_names} n JOIN {labels} l ON l.doc_id = n.item
    JOIN (SELECT string_split(name, '_')[5] AS music, count(*) AS plays FROM {seq_names} GROUP BY 1) m ON m.music = string_split(n.name, '_')[-2]""")
def modality_inner(v):
    music = v.seq_names.groupBy(F.split_part("name", F.lit("_"), F.lit(5)).alias("music")).agg(F.count(F.lit(1)).alias("plays"))
    meta = v.labels.select(F.col("doc_id").alias("item"), "quality")
    return sel.modality_inner(v.seq_names, meta, music, "item", "name").select("item", "name", "quality", "plays")


@query("length_align", f"""
    SELECT a.clip, count(*) AS frames, {hu('sum(a.x * b.y)', 4)} AS product FROM {{frames}} a JOIN {{signal}} b ON b.clip = a.clip + 1 AND b.i = a.frame GROUP BY 1""")
def length_align(v):
    music = v.signal.select((F.col("clip") - 1).alias("clip"), F.col("i").alias("frame"), "y")
    both = sel.align_lengths(v.frames.select("clip", "frame", "x"), music, "clip", "frame")
    return rounded(both.groupBy("clip").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("x") * F.col("y")).alias("product")), "product", digits=4)


@query("window_contains_segment", """
    SELECT clip, motion, w.start AS window_start, 2 * start_frame - w.start AS start_frame, 2 * end_frame - w.start AS end_frame
    FROM {segments} JOIN (SELECT clip, unnest(range(0, n_frames * 2 - 48 + 1, 8)) AS start FROM {lengths} WHERE n_frames * 2 >= 48) w USING (clip)
    WHERE 2 * start_frame >= w.start AND 2 * end_frame < w.start + 48""")
def window_contains_segment(v):
    doubled = v.lengths.select("clip", (F.col("n_frames") * 2).alias("n60"))
    return tl.segments_in_windows(v.segments, doubled, "clip", "n60", 48, 8)


@query("fps_rescale", """
    SELECT clip, motion, 2 * start_frame - 16 AS start_60, 2 * end_frame - 16 AS end_60,
           CAST(round_even(start_frame / 24.0 * 30.0, 0) AS BIGINT) AS start_30 FROM {segments}""")
def fps_rescale(v):
    s = v.segments
    return s.select("clip", "motion", sel.rescale_frames(F.col("start_frame"), 2, 16).alias("start_60"),
                    sel.rescale_frames(F.col("end_frame"), 2, 16).alias("end_60"),
                    sel.seconds_to_frames(F.col("start_frame") / 24.0).alias("start_30"))


# overlapping segments with texts: one long segment per label run opening, of length 1 + k % 9
S["loose_segments"] = """
    SELECT clip, frame AS start_frame, frame + 1 + k % 9 AS end_frame, 'm' || CAST(k AS STRING) AS note FROM {frames} WHERE k < 25"""


@query("frame_in_segment", """
    SELECT f.clip, f.frame, coalesce(first(s.note ORDER BY s.start_frame, s.end_frame, s.note), '') AS note
    FROM {frames} f LEFT JOIN {loose_segments} s ON s.clip = f.clip AND s.start_frame <= f.frame AND f.frame < s.end_frame GROUP BY ALL""")
def frame_in_segment(v):
    return tl.frames_in_segments(v.frames.select("clip", "frame"), v.loose_segments, "clip", "frame", "note")


TOKENS = 6


def tokens_sql(mode: str) -> str:
    span = (f"range(greatest(0, start_frame // 8 - w // 8), least({TOKENS}, end_frame // 8 - w // 8))"
            if mode in ("full", "time_only") else f"range({TOKENS})")
    rule = "part = 'up' AND d <> 'lower_body' OR part = 'down' AND d <> 'upper_body'" if mode in ("full", "part_only") else "TRUE"
    return f"""SELECT '{mode}' AS mode, clip, w AS "window", motion AS idx, token, part, d AS domain
        FROM (SELECT clip, w, motion, unnest({span}) AS token FROM (SELECT clip, window_start AS w, motion, start_frame, end_frame FROM seg))
        CROSS JOIN (VALUES ('up'), ('down')) p(part) CROSS JOIN (VALUES ('upper_body'), ('lower_body'), ('torso'), ('whole_body'), ('simple_tag')) q(d) WHERE {rule}"""


@query("token_overlap", f"""
    WITH seg AS (SELECT clip, motion, w.start AS window_start, 2 * start_frame AS start_frame, 2 * end_frame AS end_frame
                 FROM {{segments}} JOIN (SELECT clip, unnest(range(0, n_frames * 2 - 48 + 1, 16)) AS start FROM {{lengths}} WHERE n_frames * 2 >= 48) w USING (clip)
                 WHERE 2 * start_frame >= w.start AND 2 * end_frame < w.start + 48)
    SELECT mode, part, domain, token, count(*) AS n, count(DISTINCT clip) AS clips FROM ({' UNION ALL '.join(tokens_sql(m) for m in ('full', 'time_only', 'part_only', 'none'))}) GROUP BY ALL""")
def token_overlap(v):
    doubled = v.lengths.select("clip", (F.col("n_frames") * 2).alias("n60"))
    seg = tl.segments_in_windows(v.segments, doubled, "clip", "n60", 48, 16).select(
        "clip", F.col("window_start").alias("window"), F.col("motion").alias("idx"),
        (F.col("start_frame") + F.col("window_start")).alias("start_frame"), (F.col("end_frame") + F.col("window_start")).alias("end_frame"))
    windows = seg.select("clip", "window").distinct().withColumn("window_token", F.floor(F.col("window") / 8))
    out = None
    for mode in ("full", "time_only", "part_only", "none"):
        part = tl.token_overlap(seg, windows, "clip", TOKENS, mode).select(F.lit(mode).alias("mode"), "clip", "token", "part", "domain")
        out = part if out is None else out.unionByName(part)
    # two-level distinct count: per (group, clip) first
    per_clip = out.groupBy("mode", "part", "domain", "token", "clip").agg(F.count(F.lit(1)).alias("c"))
    return per_clip.groupBy("mode", "part", "domain", "token").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("clips"))


@query("mask_mode_alias", """
    SELECT o_orderkey, CASE raw WHEN 'no_body_mask' THEN 'time_only' WHEN 'no_temporal_mask' THEN 'part_only' WHEN 'no_mask' THEN 'none' WHEN 'part_only' THEN 'part_only' ELSE 'full' END AS mode
    FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'no_body_mask' WHEN '2-HIGH' THEN 'no_temporal_mask' WHEN '3-MEDIUM' THEN 'no_mask' WHEN '5-LOW' THEN 'part_only' ELSE 'whatever' END AS raw FROM {orders})""")
def mask_mode_alias(v):
    raw = (F.when(F.col("o_orderpriority") == "1-URGENT", "no_body_mask").when(F.col("o_orderpriority") == "2-HIGH", "no_temporal_mask")
           .when(F.col("o_orderpriority") == "3-MEDIUM", "no_mask").when(F.col("o_orderpriority") == "5-LOW", "part_only").otherwise("whatever"))
    return v.orders.select("o_orderkey", tl.mask_mode(raw).alias("mode"))


D["bar_assigned"] = """
    WITH RECURSIVE caps AS (SELECT base, start_frame, end_frame, row_number() OVER (PARTITION BY base ORDER BY start_frame, end_frame) - 1 AS i FROM {timeline}),
    b AS (SELECT clip AS base, bar, end_sec, max(bar) OVER (PARTITION BY clip) AS last_bar FROM {bars}),
    walk AS (SELECT base, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS bar, FALSE AS kept, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e FROM (SELECT DISTINCT base FROM caps) JOIN (SELECT base FROM b WHERE bar = 0) USING (base)
        UNION ALL
        SELECT w.base, c.i, CASE WHEN b.end_sec IS NULL OR c.end_frame / 30.0 <= b.end_sec OR c.start_frame / 30.0 < b.end_sec THEN w.bar ELSE w.bar + 1 END,
               b.end_sec IS NOT NULL AND (c.end_frame / 30.0 <= b.end_sec OR c.start_frame / 30.0 >= b.end_sec AND w.bar < b.last_bar), c.start_frame, c.end_frame
        FROM walk w JOIN caps c ON c.base = w.base AND c.i = w.i + 1 LEFT JOIN b ON b.base = w.base AND b.bar = w.bar)
    SELECT base, s AS start_frame, e AS end_frame, bar, kept FROM walk WHERE i >= 0"""


@query("bar_bucketing", """
    SELECT base, start_frame, end_frame, CASE WHEN kept THEN bar ELSE -1 END AS bar, CAST(kept AS BIGINT) AS kept FROM {bar_assigned}""")
def bar_bucketing(v):
    captions = tl.greedy_timeline(global_segments(v), "base").select("base", "start_frame", "end_frame")
    song_bars = bars(v).withColumnRenamed("clip", "base")
    out = tl.bar_bucketing(captions, song_bars, "base")
    kept = F.col("dropped") == ""
    return out.select("base", "start_frame", "end_frame", F.when(kept, F.col("bar")).otherwise(-1).alias("bar"), kept.cast("bigint").alias("kept"))


@query("bars_containing", """
    SELECT s.clip, s.motion, b.bar FROM {segments} s JOIN {bars} b ON b.clip = s.clip AND s.start_frame / 30.0 >= b.start_sec AND s.end_frame / 30.0 <= b.end_sec""")
def bars_containing(v):
    return tl.bars_containing(v.segments, bars(v), "clip").select("clip", "motion", "bar")


S["song_beats"] = "SELECT CAST(floor(clip / 12) AS BIGINT) AS base, (frame + 7 * (clip % 12)) / 30.0 AS t FROM {frames} WHERE label = 'click'"


@query("events_in_slice", f"""
    SELECT base, slice_idx, {hu('t')} AS t, CAST(least(greatest(floor((t - slice_idx * 0.5) / 4.8 * 144), 0), 143) AS BIGINT) AS frame_index
    FROM {{song_beats}} JOIN (SELECT DISTINCT base, slice_idx FROM {{slices}}) USING (base) WHERE t >= slice_idx * 0.5 AND t < slice_idx * 0.5 + 4.8""")
def events_in_slice(v):
    return rounded(tl.events_in_slices(v.song_beats, v.slices, "base"), "t")


S["chords"] = """
    SELECT clip, frame / 30.0 AS chord_start, (frame + 2) / 30.0 AS chord_end, upper(substr(label, 1, 1)) || CAST(k % 7 AS STRING) AS chord FROM {frames}"""


@query("chords_in_range", f"""
    SELECT b.clip, b.bar, {hu('b.start_sec')} AS start_sec, coalesce(string_agg(chord, '-' ORDER BY chord_start), '') AS chords
    FROM {{bars}} b LEFT JOIN {{chords}} c ON c.clip = b.clip AND c.chord_start >= b.start_sec AND c.chord_end <= b.end_sec GROUP BY b.clip, b.bar, b.start_sec""")
def chords_in_range(v):
    out = tl.chords_in_ranges(bars(v), v.chords, "clip", "bar")
    return rounded(out.select("clip", "bar", "start_sec", "chords"), "start_sec")


D["motion_beats"] = """
    SELECT clip, frame FROM (SELECT clip, frame, x, lag(x) OVER w AS a, lead(x) OVER w AS b FROM {frames} WINDOW w AS (PARTITION BY clip ORDER BY frame)) WHERE x < a AND x < b"""


def motion_beats(v):
    return mo.local_minima(v.frames.select("clip", "frame", "x"), ["clip"], "frame", "x", 1).select("clip", "frame")


@query("nearest_beat", """
    SELECT m.clip, m.frame, min((d.frame - m.frame) * (d.frame - m.frame)) AS distance_sq
    FROM {music_beats} m JOIN {motion_beats} d USING (clip) GROUP BY ALL""")
def nearest_beat(v):
    return tl.nearest_beats(v.music_beats, motion_beats(v), "clip", "frame").filter("distance_sq IS NOT NULL")


@query("sequence_name_parse", """
    SELECT item, p[1] AS genre_code, p[2] AS style, p[3] AS camera, p[4] AS dancer, p[5] AS music, p[6] AS take,
           coalesce(TRY_CAST(regexp_extract(name, '_slice([0-9]+)', 1) AS BIGINT), 0) AS slice_idx
    FROM (SELECT item, name, string_split(name, '_') AS p FROM {seq_names})""")
def sequence_name_parse(v):
    return names.parse_sequence_name(v.seq_names, "name").drop("name", "price")


@query("camera_rename", """
    SELECT item, replace(name, '_cAll_', '_c01_') AS first_camera, replace(replace(name, '_cAll_', '_c01_'), '_c01_', '_cAll_') AS all_cameras FROM {seq_names}""")
def camera_rename(v):
    first = v.seq_names.select("item", names.to_first_camera(F.col("name")).alias("first_camera"))
    return first.withColumn("all_cameras", names.to_all_cameras(F.col("first_camera")))


S["takes"] = "SELECT item, CASE WHEN price > 1000 THEN substr(name, 2) ELSE name END AS name FROM {seq_names}"


@query("take_eligibility", """
    SELECT 'inside' AS corpus, name, count(*) AS n FROM {takes} WHERE starts_with(name, 'g') GROUP BY 2
    UNION ALL SELECT 'outside', name, count(*) FROM {takes} WHERE NOT starts_with(name, 'g') GROUP BY 2
    UNION ALL SELECT 'second', name, count(*) FROM {takes} WHERE starts_with(name, 'g') AND NOT (contains(name, 'ch01') AND replace(name, 'ch01', 'ch02') IN (SELECT name FROM {takes})) GROUP BY 2""")
def take_eligibility(v):
    t = v.takes
    count = lambda df, tag: df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit(tag).alias("corpus"), "name", "n")
    return (count(names.eligible_takes(t, "name"), "inside")
            .unionByName(count(names.eligible_takes(t, "name", inside=False), "outside"))
            .unionByName(count(names.eligible_takes(t, "name", prefer_second=True), "second")))


@query("code_lookup", """
    SELECT item, coalesce(g.genre, 'any') AS genre,
           CASE WHEN g.genre IS NOT NULL AND i < 6 THEN CASE WHEN g.genre = 'House' THEN 110 + 5 * i ELSE 80 + 10 * i END END AS bpm
    FROM (SELECT item, string_split(name, '_')[5] AS music, CAST(substr(string_split(name, '_')[5], 4, 1) AS BIGINT) AS i FROM {seq_names}) n
    LEFT JOIN (VALUES ('mBR', 'Break'), ('mPO', 'Pop'), ('mLO', 'Lock'), ('mWA', 'Waack'), ('mMH', 'Middle Hip-hop'), ('mLH', 'LA-style Hip-hop'),
                      ('mHO', 'House'), ('mKR', 'Krump'), ('mJS', 'Street Jazz'), ('mJB', 'Ballet Jazz')) g(code, genre) ON g.code = substr(music, 1, 3)""")
def code_lookup(v):
    parsed = names.parse_sequence_name(v.seq_names, "name").select("item", "music")
    return names.code_lookup(parsed, "music").select("item", "genre", "bpm")


@query("slice_thinning", """
    SELECT base, slice_idx FROM (SELECT DISTINCT base, slice_idx FROM {slices}) a
    WHERE NOT (slice_idx % 10 <> 0 AND EXISTS (FROM {slices} b WHERE b.base = a.base AND b.slice_idx = (a.slice_idx // 10 + 1) * 10))""")
def slice_thinning(v):
    return names.slice_thinning(v.slices.select("base", "slice_idx").distinct(), "base", "slice_idx")


@query("title_near_dup", """
    WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {documents}),
         u AS (SELECT min(doc_id) AS first_id, list(doc_id) AS ids, list_sort(w) AS w FROM t GROUP BY 3),
         hit AS (SELECT DISTINCT a.first_id FROM u a JOIN u b ON b.first_id < a.first_id AND least(len(a.w), len(b.w)) >= 0.85 * greatest(len(a.w), len(b.w)) - 1e-9
                 AND len(list_intersect(a.w, b.w)) >= 0.85 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))))
    SELECT id AS doc_id, CAST(id > first_id OR first_id IN (SELECT first_id FROM hit) AS BIGINT) AS duplicate FROM (SELECT first_id, unnest(ids) AS id FROM u)""")
def title_near_dup(v):
    tokens = v.documents.select("doc_id", titles.title_tokens(F.col("text")).alias("tokens"))
    out = titles.near_duplicates(tokens, "doc_id", "tokens", 0.85)
    return out.withColumn("duplicate", F.col("duplicate").cast("bigint"))


@query("cover_or_next_segment", """
    WITH n AS (SELECT DISTINCT base, end_frame AS pt FROM {global_segments})
    SELECT base, pt, coalesce(c, f) // 1000000 AS start_frame, coalesce(c, f) % 1000000 AS end_frame, CAST(c IS NOT NULL AS BIGINT) AS covered FROM (
        SELECT n.base, pt, max(start_frame * 1000000 + end_frame) FILTER (start_frame <= pt AND pt < end_frame) AS c,
               min(start_frame * 1000000 + end_frame) FILTER (start_frame > pt) AS f
        FROM n JOIN {global_segments} g ON g.base = n.base GROUP BY ALL) WHERE coalesce(c, f) IS NOT NULL""")
def cover_or_next_segment(v):
    segs = global_segments(v)
    points = segs.select("base", F.col("end_frame").alias("pt")).distinct()
    out = tl.cover_or_next(points, segs, "base", "pt", ["slice_idx", "motion"]).filter("chosen IS NOT NULL")
    return out.select("base", "pt", "chosen.start_frame", "chosen.end_frame", F.col("covered").cast("bigint").alias("covered"))


@query("document_validity", """
    SELECT conv_id, CAST(bool_and(ok) AS BIGINT) AS valid, count(*) AS parts FROM (SELECT conv_id, length(text) >= 40 AS ok FROM {conversations}) GROUP BY 1""")
def document_validity(v):
    from cadenza.operators import captions as cp

    parts = v.conversations.select("conv_id", F.when(F.length("text") >= 40, F.split("text", " ")).alias("sentence"), F.lit("s").alias("summary"))
    return cp.document_validity(parts, "conv_id", ["summary"], "sentence").withColumn("valid", F.col("valid").cast("bigint"))


@query("length_cap", """
    SELECT 'kept' AS bucket, count(*) AS n, round(count(*) / (SELECT count(*) FROM {lengths}), 6) AS rate FROM {lengths} WHERE n_frames <= 70
    UNION ALL SELECT 'dropped', count(*), round(count(*) / (SELECT count(*) FROM {lengths}), 6) FROM {lengths} WHERE n_frames > 70""")
def length_cap(v):
    return sel.length_cap(v.lengths, "n_frames", 70)[1]
