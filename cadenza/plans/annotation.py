"""The annotation job: slices of videos and their captions in, song documents out, by stages that are kept as tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import captions as cp
from cadenza.operators import inventory
from cadenza.operators import timeline as tl
from cadenza.sources.scratch import by_merge, checkpointed

MODIFIER = {d: d.replace(" ", "_") for d in cp.DOMAINS}


@dataclass(frozen=True)
class Inputs:
    """Tables of the job; ``base`` is a video or song, ``file`` one slice of it.

    ``slices(base, file, slice_idx, motion, start_frame, end_frame)`` with frames counted from the slice's start,
    ``poses`` and ``transitions(file, motion, cues)``, ``responses(file, motion, response)``, ``bars(base, bar,
    start_sec, end_sec)``, ``chords(base, chord_start, chord_end, chord)``, ``syntheses(base, bar, synthesis)`` and
    ``songs(base, genre, key, bpm, overall, structure, intent)``.
    """

    slices: DataFrame
    poses: DataFrame
    transitions: DataFrame
    responses: DataFrame
    bars: DataFrame
    chords: DataFrame
    syntheses: DataFrame
    songs: DataFrame


def slices_of(labels: DataFrame, base: str, pos: str, label: str, units: int = 18, length: int = 150) -> DataFrame:
    """Segments of every slice of ``units`` labels, ready for the job: label runs, unit runs merged, rescaled."""
    blocks = tl.slice_blocks(labels, base, pos, label, units, length)
    file = F.concat(F.col(base).cast("string"), F.lit("_"), F.col("slice_idx").cast("string"))
    return blocks.select(F.col(base).alias("base"), file.alias("file"), "slice_idx", "motion", "start_frame", "end_frame")


def captioned(given: Inputs) -> DataFrame:
    """Segments with cues and parsed captions, and one row with a ``reason`` for each file that lacks a domain.

    A file of which one caption lacks a domain is rejected as a whole.
    """
    keys = ["file", "motion"]
    cues = cp.interleave(given.poses, given.transitions, keys, "cues")
    found = cp.annotation_lookup(given.slices, cues, given.responses, keys, "cues", "response")
    # responses are parsed once; the rows are read three times
    judged = by_merge(checkpointed(cp.judged_captions(found, "motion", "response").drop("response")))
    good, rejected = cp.good_and_rejected(judged, "file", "motion")
    return good.unionByName(rejected, allowMissingColumns=True)


def timeline(segments: DataFrame, step: int, min_step: int) -> DataFrame:
    """One gapless timeline a video, each part with cues and modifier of the segment it was taken from."""
    placed = tl.globalize(segments.filter("reason IS NULL").drop("reason"), step)
    walked = tl.greedy_timeline(placed, "base", min_step)
    return walked.join(by_merge(placed.select("base", "slice_idx", "motion", "file", "cues", "modifier")), ["base", "slice_idx", "motion"])


def sentences(placed: DataFrame, given: Inputs, fps: float) -> DataFrame:
    """One row a bar that holds a segment: number, times and the summary text of its movements in order."""
    part = F.struct("start_frame", "end_frame", *[F.col(f"modifier.{k}").alias(k) for k in MODIFIER.values()])
    rows = F.array_sort(F.collect_list(part))
    block = lambda r, i: cp.movement_block(
        i + 1, r["start_frame"] / fps, r["end_frame"] / fps, {name: r[k] for name, k in MODIFIER.items()})
    moves = placed.filter("dropped = ''").groupBy("base", "bar").agg(F.array_join(F.transform(rows, block), "").alias("_moves"))
    heard = tl.chords_in_ranges(given.bars, given.chords, "base", "bar")
    told = moves.join(by_merge(heard), ["base", "bar"]).join(by_merge(given.syntheses), ["base", "bar"], "left").join(by_merge(given.songs), "base")
    summary = cp.sentence_summary(F.col("genre"), F.col("start_sec"), F.col("end_sec"), F.col("key"), F.col("chords"), F.col("bpm"),
                                  F.coalesce("synthesis", F.lit("")), F.col("_moves"))
    return told.select("base", "bar", (F.col("bar") + 1).alias("n"), "start_sec", "end_sec", summary.alias("sentence_summary"))


def songs(told: DataFrame, placed: DataFrame, given: Inputs) -> DataFrame:
    """``(base, summary, segments)``: the document text of a song and its segments nested by bar."""
    texts = cp.section_texts(told, "base", "n").join(by_merge(given.songs), "base")
    summary = cp.song_summary(F.col("overall"), F.col("structure"), F.col("intent"), F.col("sections"))
    fields = ["start_frame", "end_frame", "slice_idx", "motion", "cues", "modifier"]
    return texts.select("base", summary.alias("summary")).join(
        by_merge(cp.nest_segments(placed.filter("dropped = ''"), "base", "bar", "start_frame", fields)), "base")


def rejects(captions: DataFrame, placed: DataFrame) -> DataFrame:
    """``(step, file, start_frame, reason)`` of what the steps left out."""
    files = captions.filter("reason IS NOT NULL").select(
        F.lit("captions").alias("step"), F.col("file").cast("string").alias("file"), F.lit(None).cast("bigint").alias("start_frame"), "reason")
    parts = placed.filter("dropped <> ''").select(
        F.lit("bars").alias("step"), F.col("file").cast("string").alias("file"), "start_frame", F.col("dropped").alias("reason"))
    return files.unionByName(parts)


def stages(given: Inputs, step: int = 15, min_step: int = 10, fps: float = 30.0) -> list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]]:
    """The job's stages for ``inventory.run_stages``; each reads the stored tables of the ones before it."""
    return [
        ("captions", lambda done: captioned(given)),
        ("timeline", lambda done: timeline(done["captions"], step, min_step)),
        ("placed", lambda done: tl.bar_bucketing(done["timeline"], given.bars.select("base", "bar", "end_sec"), "base", fps)),
        ("sentences", lambda done: sentences(done["placed"], given, fps)),
        ("songs", lambda done: songs(done["sentences"], done["placed"], given)),
        ("rejects", lambda done: rejects(done["captions"], done["placed"])),
    ]


def annotate(spark: SparkSession, given: Inputs, folder: str, run_from: str = "captions", step: int = 15, min_step: int = 10,
             fps: float = 30.0) -> dict[str, DataFrame]:
    """Run the job from a stage on; the tables of earlier stages are read from ``folder``.  Empty inputs give empty tables."""
    return inventory.run_stages(spark, stages(given, step, min_step, fps), folder, run_from)
