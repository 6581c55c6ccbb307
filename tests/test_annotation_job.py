"""The annotation job: equal to its single steps, resumed from a stage, empty inputs."""

import dataclasses

from pyspark.sql import functions as F

from cadenza.operators import captions as cp
from cadenza.operators import intervals, scan
from cadenza.operators import sequence as seq
from cadenza.operators import timeline as tl
from cadenza.plans import annotation
from cadenza.sources.scratch import checkpointed

TABLES = {
    "slices": "base long, file string, slice_idx long, motion long, start_frame long, end_frame long",
    "poses": "file string, motion long, cues array<string>",
    "transitions": "file string, motion long, cues array<string>",
    "responses": "file string, motion long, response string",
    "bars": "base long, bar long, start_sec double, end_sec double",
    "chords": "base long, chord_start double, chord_end double, chord string",
    "syntheses": "base long, bar long, synthesis string",
    "songs": "base long, genre string, key string, bpm long, overall string, structure string, intent string",
}


def response(word, domains=cp.DOMAINS):
    return "\n".join(f"**{d}**\n{word} {d}" for d in domains)


def inputs(spark, **rows):
    return annotation.Inputs(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in TABLES.items()})


def test_job_equals_its_steps_and_resumes(spark, tmp_path):
    labels = spark.createDataFrame([(1, i, "ab"[(i // 5) % 2]) for i in range(36)], "video long, unit long, label string")
    made = annotation.slices_of(labels, "video", "unit", "label").collect()
    slices = [tuple(r) for r in made] + [(2, "2_0", 0, 0, 0, 60), (2, "2_0", 0, 1, 60, 150)]
    texts = [(r[1], r[3], response(f"m{r[3]}")) for r in slices if r[0] == 1] + [("2_0", 0, response("x")), ("2_0", 1, response("x", cp.DOMAINS[:2]))]
    given = inputs(
        spark, slices=slices, responses=texts, poses=[("1_0", 0, ["p0", "p1"])], transitions=[("1_0", 0, ["t0"])],
        bars=[(1, i, 2.0 * i, 2.0 * i + 2.0) for i in range(3)], chords=[(1, 0.5, 0.9, "C"), (1, 1.0, 1.5, "G"), (1, 1.9, 2.1, "D")],
        syntheses=[(1, 0, "rise"), (1, 1, "fall")], songs=[(1, "Jazz", "A", None, "calm", "two", "flow"), (2, "Pop", "B", 90, "", "", "")])
    folder = str(tmp_path / "job")
    done = annotation.annotate(spark, given, folder)

    good = given.slices.filter("base = 1")
    walked = tl.greedy_timeline(tl.globalize(good, 15), "base").select("base", "start_frame", "end_frame", "slice_idx", "motion")
    placed = tl.bar_bucketing(walked, given.bars.select("base", "bar", "end_sec"), "base")
    columns = ["base", "start_frame", "end_frame", "slice_idx", "motion", "bar", "dropped"]
    assert sorted(map(tuple, done["placed"].select(*columns).collect()), key=str) == sorted(map(tuple, placed.select(*columns).collect()), key=str)

    nested = {}
    for r in placed.filter("dropped = ''").orderBy("start_frame").collect():
        nested.setdefault(r.bar, []).append((r.start_frame, r.end_frame, r.motion))
    song = done["songs"].collect()
    assert len(song) == 1 and nested
    assert {b.bar: [(s.start_frame, s.end_frame, s.motion) for s in b.sentence] for b in song[0].segments} == nested
    first = song[0].segments[0].sentence[0]
    assert first.cues == ["p0", "t0", "p1"] and first.modifier.torso == "m0 torso"
    told = {r.bar: r.sentence_summary for r in done["sentences"].collect()}
    assert set(told) == set(nested) and "chord progression C-G, and tempo None BPM" in told[0]
    assert all(told[b].count("***Movement ") == len(rows) for b, rows in nested.items())
    assert "Segment 1: 0.00 - 2.00.\nrise\n" in song[0].summary and "calm" in song[0].summary
    left_out = {(r.step, r.file): r.reason for r in done["rejects"].collect()}
    assert left_out["captions", "2_0"].startswith("motion 1 lacks: ")
    assert done["rejects"].filter("step = 'bars'").count() == placed.filter("dropped <> ''").count()

    # earlier tables are read back: the captions are gone, the song's facts are new
    changed = dataclasses.replace(given, responses=given.responses.limit(0), songs=given.songs.withColumn("overall", F.lit("loud")))
    again = annotation.annotate(spark, changed, folder, run_from="songs")
    assert "loud" in again["songs"].first().summary and {(r.step, r.file) for r in again["rejects"].collect()} == set(left_out)


def test_no_table_of_the_job_goes_through_the_driver(spark, monkeypatch):
    """Stored tables are small files here; joins must not be chosen by that, and responses are parsed in one pass."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpointed(df)

    for module in (annotation, intervals, scan, seq, tl):
        monkeypatch.setattr(module, "checkpointed", seen, raising=False)
    rows = inputs(
        spark, slices=[(1, "1_0", 0, 0, 0, 60), (1, "1_0", 0, 1, 60, 150), (2, "2_0", 0, 0, 0, 60)],
        poses=[("1_0", 0, ["p0"])], transitions=[("1_0", 0, ["t0"])], responses=[("1_0", m, response(f"m{m}")) for m in (0, 1)],
        bars=[(1, i, 2.0 * i, 2.0 * i + 2.0) for i in range(3)], chords=[(1, 0.5, 0.9, "C")],
        syntheses=[(1, 0, "rise")], songs=[(1, "Jazz", "A", 90, "calm", "two", "flow")])
    given = annotation.Inputs(**{name: checkpointed(getattr(rows, name)) for name in TABLES})
    done = {}
    for name, stage in annotation.stages(given):
        done[name] = seen(stage(done))
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    # the states of a scan, one row a range, are the only ones that are sent
    assert sum("SortMergeJoin" in j for j in joins) > 20 and [j for j in joins if "SortMergeJoin" not in j and "_scan_range" not in j] == []
    assert ["Union" in plan for plan in plans if r"(?is)whole body\s" in plan] == [False]
    assert done["songs"].count() == 1 and done["rejects"].filter("step = 'captions'").count() == 1


def test_empty_inputs(spark, tmp_path):
    done = annotation.annotate(spark, inputs(spark), str(tmp_path / "job"))
    assert [done[name].count() for name in ("captions", "placed", "songs", "rejects")] == [0, 0, 0, 0]
