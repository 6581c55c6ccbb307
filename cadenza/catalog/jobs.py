"""Composed jobs: the training loader and the annotation job."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.catalog import views as vw
from cadenza.catalog.registry import half_up as hu
from cadenza.catalog.documents import ADVICE
from cadenza.catalog.registry import query, rounded
from cadenza.catalog.sequences import bars
from cadenza.plans import annotation, training
from cadenza.sources.scratch import by_merge, checkpointed, scratch_path

D = vw.DUCK
S = vw.SHARED

S["clip_names"] = "SELECT item AS clip, name FROM {seq_names}"
S["clip_meta"] = "SELECT doc_id AS clip, quality FROM {labels}"
S["music_frames"] = """
    SELECT m.music, s.i AS frame, s.y AS value FROM {signal} s
    JOIN (SELECT split_part(name, '_', 5) AS music, min(clip) AS clip FROM {clip_names} GROUP BY 1) m ON m.clip = s.clip"""


@query("training_records", f"""
    WITH u AS (SELECT DISTINCT n.clip, split_part(n.name, '_', -2) AS music FROM {{clip_names}} n JOIN {{clip_meta}} q ON q.clip = n.clip),
         heard AS (SELECT u.clip, m.frame, m.value AS music FROM u JOIN {{music_frames}} m USING (music)),
         root AS (SELECT clip, frame, x AS rx, y AS ry, z AS rz FROM {{joints}} WHERE joint = 0),
         moved AS (SELECT j.clip, j.frame, sum(CASE WHEN joint = 0 THEN x + y + z ELSE x - rx + y - ry + z - rz END) AS points
                   FROM {{joints}} j JOIN root r ON r.clip = j.clip AND r.frame = j.frame GROUP BY ALL),
         f AS (SELECT m.clip, m.frame, m.points, h.music FROM moved m JOIN heard h ON h.clip = m.clip AND h.frame = m.frame),
         n AS (SELECT clip, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 24),
         w AS (SELECT clip, 'strided' AS scheme, unnest(range(0, n - 24 + 1, 8)) AS start FROM n
               UNION ALL SELECT clip, 'tumbling', unnest(range(0, n - 24 + 1, 24)) FROM n
               UNION ALL SELECT clip, 'every', unnest(range(0, n - 24 + 1)) FROM n),
         s AS (SELECT w.clip, w.scheme, w.start, count(*) AS segments,
                      string_agg(motion || ':' || (2 * start_frame - start) || '-' || (2 * end_frame - start), ',' ORDER BY start_frame, end_frame, motion) AS texts
               FROM w JOIN {{segments}} g ON g.clip = w.clip AND 2 * g.start_frame >= w.start AND 2 * g.end_frame < w.start + 24 GROUP BY ALL)
    SELECT w.clip, w.scheme, w.start, CASE WHEN w.scheme <> 'every' THEN 24 WHEN w.start = 0 THEN 22 ELSE 1 END::BIGINT AS active,
           {hu('sum(CASE WHEN f.frame >= w.start AND f.frame < w.start + 24 THEN points END)', 4)} AS points,
           {hu('sum(CASE WHEN f.frame >= w.start AND f.frame < w.start + 24 THEN f.music END)', 4)} AS music,
           {hu('sum(points)', 4)} AS context, coalesce(any_value(s.segments), 0) AS segments, coalesce(any_value(s.texts), '') AS texts
    FROM w JOIN f ON f.clip = w.clip AND f.frame >= w.start - 5 AND f.frame < w.start + 29
    LEFT JOIN s ON s.clip = w.clip AND s.scheme = w.scheme AND s.start = w.start GROUP BY w.clip, w.scheme, w.start""")
def training_records(v):
    frames = training.aligned_sequences(v.joints, v.music_frames, v.clip_names, v.clip_meta, "clip", "name")
    records = training.window_records(frames, v.segments, "clip")
    total = lambda rows: F.aggregate(rows, F.lit(0.0), lambda a, b: a + b)
    one = lambda x: F.concat(x["motion"].cast("string"), F.lit(":"), x["start_frame"].cast("string"), F.lit("-"), x["end_frame"].cast("string"))
    return rounded(records.select(
        "clip", "scheme", "start", F.aggregate("mask", F.lit(0), lambda a, b: a + b).alias("active"),
        total(F.flatten("motion")).alias("points"), total(F.col("music")).alias("music"), total(F.flatten("context")).alias("context"),
        F.size("segments").alias("segments"), F.array_join(F.transform("segments", one), ",").alias("texts"),
    ), "points", "music", "context", digits=4)


# ---- annotation ------------------------------------------------------------------------
S["song_facts"] = """
    SELECT DISTINCT base, 'Break' AS genre, 'C' AS key, CASE WHEN base % 3 <> 0 THEN 80 + base END AS bpm,
           'mood ' || CAST(base AS STRING) AS overall, 'parts' AS structure, 'intent' AS intent FROM {slices}"""
S["base_chords"] = "SELECT clip AS base, chord_start, chord_end, chord FROM {chords}"
HEADS = list(annotation.MODIFIER.values())
GAPS = ", ".join(f"CASE WHEN {k} IS NULL THEN '{d}' END" for d, k in annotation.MODIFIER.items())
D["slice_captions"] = f"""
    SELECT s.*, {', '.join(f'p.{k}' for k in HEADS)}, list_filter([{GAPS}], lambda h: h IS NOT NULL) AS gaps
    FROM {{slices}} s LEFT JOIN {{parsed_captions}} p ON p.file = s.clip AND p.motion = s.motion % 2"""
D["rejected_files"] = """
    SELECT clip, 'motion ' || min(motion) FILTER (len(gaps) > 0) || ' lacks: ' || array_to_string(arg_min(gaps, motion) FILTER (len(gaps) > 0), ', ') AS reason
    FROM {slice_captions} GROUP BY clip HAVING count(*) FILTER (len(gaps) > 0) > 0"""
D["good_segments"] = """
    SELECT * REPLACE (start_frame + 15 * slice_idx AS start_frame, end_frame + 15 * slice_idx AS end_frame) FROM {slice_captions}
    WHERE clip NOT IN (SELECT clip FROM {rejected_files}) AND end_frame - start_frame >= 1"""
D["good_timeline"] = D["timeline"].replace("{global_segments}", "{good_segments}")
D["good_bars"] = D["bar_assigned"].replace("{timeline}", "{good_timeline}")
LINES = " || ".join(f"'{d}: ' || coalesce(g.{k}, '') || chr(10)" for d, k in annotation.MODIFIER.items())
D["job_parts"] = f"""
    SELECT a.base, a.bar, a.start_frame, t.end_frame, t.slice_idx, t.motion, a.kept, g.clip,
           row_number() OVER (PARTITION BY a.base, a.bar, a.kept ORDER BY a.start_frame) AS i, {LINES} AS lines
    FROM {{good_bars}} a JOIN {{good_timeline}} t ON t.base = a.base AND t.start_frame = a.start_frame
    JOIN {{good_segments}} g ON g.base = t.base AND g.slice_idx = t.slice_idx AND g.motion = t.motion"""
D["job_sections"] = """
    SELECT base, string_agg('Segment ' || (bar + 1) || ': ' || printf('%.2f', start_sec) || ' - ' || printf('%.2f', end_sec) || '.' || chr(10) || 'bar ' || bar || chr(10), '' ORDER BY bar) AS sections
    FROM (SELECT DISTINCT p.base, p.bar, b.start_sec, b.end_sec FROM {job_parts} p JOIN {bars} b ON b.clip = p.base AND b.bar = p.bar WHERE kept) GROUP BY base"""


@query("annotation_job", f"""
    WITH m AS (SELECT base, bar, string_agg('***Movement ' || i || '***: ' || printf('%.2f', start_frame / 30.0) || ' - ' || printf('%.2f', end_frame / 30.0) || chr(10) || lines || chr(10), '' ORDER BY i) AS moves
               FROM {{job_parts}} WHERE kept GROUP BY ALL),
         c AS (SELECT b.clip AS base, b.bar, b.start_sec, b.end_sec, coalesce(string_agg(chord, '-' ORDER BY chord_start), '') AS chords
               FROM {{bars}} b LEFT JOIN {{chords}} h ON h.clip = b.clip AND h.chord_start >= b.start_sec AND h.chord_end <= b.end_sec GROUP BY ALL)
    SELECT 'sentence' AS kind, CAST(m.base AS VARCHAR) AS id, m.bar AS place,
           'This is a Break-style music segment lasting ' || printf('%.2f', end_sec - start_sec) || ' seconds, in key C, with chord progression ' || chords || ', and tempo '
           || CASE WHEN m.base % 3 = 0 THEN 'None' ELSE CAST(80 + m.base AS VARCHAR) END || ' BPM. {ADVICE}' || chr(10) || chr(10) || 'High-level movement synthesis:' || chr(10) || 'bar ' || m.bar
           || chr(10) || chr(10) || 'Specific movement instructions for the model:' || chr(10) || chr(10) || moves AS text
    FROM m JOIN c ON c.base = m.base AND c.bar = m.bar
    UNION ALL
    SELECT 'song', CAST(base AS VARCHAR), NULL, chr(10) || '## Overall Musical Characteristics' || chr(10) || chr(10) || 'mood ' || base || chr(10) || chr(10) || chr(10)
           || '## Musical Structure and Segment Relationships' || chr(10) || chr(10) || 'parts' || chr(10) || chr(10) || chr(10) || '## Choreographic Perspective and Design Intent'
           || chr(10) || chr(10) || 'intent' || chr(10) || chr(10) || chr(10) || '## Segment-Level Choreographic Summaries' || chr(10) || chr(10) || sections || chr(10) FROM {{job_sections}}
    UNION ALL
    SELECT 'nested', CAST(base AS VARCHAR), NULL, string_agg(bar || ':' || segs, ';' ORDER BY bar)
    FROM (SELECT base, bar, string_agg(start_frame || '-' || end_frame || '/' || slice_idx || '/' || motion, ',' ORDER BY start_frame) AS segs FROM {{job_parts}} WHERE kept GROUP BY ALL) GROUP BY base
    UNION ALL SELECT 'captions', CAST(clip AS VARCHAR), NULL, reason FROM {{rejected_files}}
    UNION ALL SELECT 'bars', CAST(clip AS VARCHAR), start_frame, 'dropped' FROM {{job_parts}} WHERE NOT kept""")
def annotation_job(v):
    song_bars = bars(v).withColumnRenamed("clip", "base")
    # read several times below
    slices = checkpointed(v.slices)
    nothing = slices.select(F.col("clip").alias("file"), "motion", F.array().cast("array<string>").alias("cues"))
    captions = slices.select("clip", "motion").join(
        by_merge(v.captions.withColumnsRenamed({"motion": "turn", "file": "clip"})), "clip").filter("turn = motion % 2").select(
        F.col("clip").alias("file"), "motion", "response")
    given = annotation.Inputs(
        slices.withColumnRenamed("clip", "file"), nothing, nothing, captions, song_bars, v.base_chords,
        song_bars.select("base", "bar", F.concat(F.lit("bar "), F.col("bar").cast("string")).alias("synthesis")), v.song_facts)
    made = annotation.annotate(v.spark, given, scratch_path(v.spark, "annotation"))
    part = lambda s: F.concat(
        s["start_frame"].cast("string"), F.lit("-"), s["end_frame"].cast("string"), F.lit("/"), s["slice_idx"].cast("string"), F.lit("/"), s["motion"].cast("string"))
    nested = F.transform("segments", lambda b: F.concat(b["bar"].cast("string"), F.lit(":"), F.array_join(F.transform(b["sentence"], part), ",")))
    rows = lambda df, kind, id, place, text: df.select(
        kind.alias("kind"), id.cast("string").alias("id"), place.cast("bigint").alias("place"), text.alias("text"))
    none, base = F.lit(None), F.col("base")
    left_out = made["rejects"]
    return (
        rows(made["sentences"], F.lit("sentence"), base, F.col("bar"), F.col("sentence_summary"))
        .unionByName(rows(made["songs"], F.lit("song"), base, none, F.col("summary")))
        .unionByName(rows(made["songs"], F.lit("nested"), base, none, F.array_join(nested, ";")))
        .unionByName(rows(left_out, F.col("step"), F.col("file"), F.col("start_frame"), F.when(F.col("step") == "bars", "dropped").otherwise(F.col("reason"))))
    )
