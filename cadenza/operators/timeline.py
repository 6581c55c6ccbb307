"""Slices, segments, beats and windows along a timeline."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators import sequence as seq
from cadenza.operators.intervals import interval_join
from cadenza.operators.scan import Scan, following, scan
from cadenza.sources.scratch import by_merge, checkpointed


def _span(first: Column, last: Column, step: int = 1) -> Column:
    """``first, first + step, ... <= last``; empty when ``last < first``."""
    whole = F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint"))
    return F.when(last >= first, whole).otherwise(F.array().cast("array<bigint>"))


# ---- slices and windows ----------------------------------------------------------------
def sliding_slices(lengths: DataFrame, length: str, window: int, stride: int, limit: int | None = None) -> DataFrame:
    """Full windows every ``stride`` frames, at most ``limit`` per sequence."""
    last = F.col(length) - window
    if limit is not None:
        last = F.least(last, F.lit((limit - 1) * stride))
    return lengths.select("*", F.explode(_span(F.lit(0), last, stride)).alias("start")).select(
        *lengths.columns,
        F.floor(F.col("start") / stride).cast("bigint").alias("slice_idx"),
        "start",
        (F.col("start") + window).alias("end"),
    )


def training_windows(lengths: DataFrame, length: str, interval: int, move: int) -> DataFrame:
    return sliding_slices(lengths, length, interval, move).drop("slice_idx")


def tumbling_windows(lengths: DataFrame, length: str, interval: int) -> DataFrame:
    """Consecutive windows, the remainder dropped."""
    return training_windows(lengths, length, interval, interval)


def masked_windows(lengths: DataFrame, length: str, interval: int) -> DataFrame:
    """A window at every offset with its training mask: all ones first, then only the last position."""
    ones = F.array_repeat(F.lit(1), interval - 2)
    last = F.concat(F.array_repeat(F.lit(0), interval - 3), F.array(F.lit(1)))
    return training_windows(lengths, length, interval, 1).withColumn("mask", F.when(F.col("start") == 0, ones).otherwise(last))


def window_rows(frames: DataFrame, lengths: DataFrame, key: str, pos: str, length: str, interval: int, move: int) -> DataFrame:
    """Each frame once per window holding it.

    The windows of a frame follow from its position, so this is an explode and a join on the
    sequence length, not a range join.
    """
    n = lengths.select(key, length)
    p = F.col(pos)
    first = F.greatest(F.ceil((p - interval + 1) / move), F.lit(0))
    last = F.least(F.floor(p / move), F.floor((F.col(length) - interval) / move))
    return frames.join(n, key).withColumn("_w", F.explode(_span(first, last))).select(
        *frames.columns, (F.col("_w") * move).alias("start"), (p - F.col("_w") * move).alias("offset")
    )


def context_pad(frames: DataFrame, lengths: DataFrame, key: str, pos: str, length: str, value: str,
                interval: int, move: int, pad: int) -> DataFrame:
    """Windows widened by ``pad`` real neighbours per side, zero where the sequence ends."""
    windows = training_windows(lengths.select(key, length), length, interval, move)
    cells = windows.select(
        key, "start", F.explode(_span(F.lit(0), F.lit(interval + 2 * pad - 1))).alias("offset")
    ).withColumn(pos, F.col("start") + F.col("offset") - pad)
    known = frames.select(key, pos, F.col(value).alias("_v"))
    return cells.join(known, [key, pos], "left").select(
        key, "start", "offset", F.coalesce("_v", F.lit(0.0)).alias(value)
    )


def tail_pad(frames: DataFrame, lengths: DataFrame, key: str, pos: str, length: str, value: str,
             multiple: int, margin: int) -> DataFrame:
    """Repeat the last row up to the next multiple (always at least once) between zero margins."""
    shifted = frames.select(key, (F.col(pos) + margin).alias(pos), value)
    n = F.col(length)
    total = (F.floor(n / multiple) + 1) * multiple
    last = frames.join(lengths.select(key, length), key).filter(F.col(pos) == n - 1)
    tail = last.select(key, F.explode(_span(n, total - 1)).alias("_p"), value).select(
        key, (F.col("_p") + margin).alias(pos), value
    )
    zero = lambda first, last: lengths.select(
        key, F.explode(_span(first, last)).alias(pos), F.lit(0.0).alias(value)
    )
    left = zero(F.lit(0), F.lit(margin - 1))
    right = zero(total + margin, total + 2 * margin - 1)
    return shifted.unionByName(tail).unionByName(left).unionByName(right)


def frame_stack(frames: DataFrame, key: str, pos: str, values: str, rate: int, skip: int = 1) -> DataFrame:
    """``rate`` consecutive rows side by side; the first ``skip`` stacked rows are left out.

    A group holds exactly ``rate`` rows; ``unstacked`` tells which rows are in no whole group.
    """
    group = F.floor(F.col(pos) / rate).cast("bigint")
    return (
        frames.groupBy(key, group.alias("step"))
        .agg(F.array_sort(F.collect_list(F.struct(pos, values))).alias("_rows"))
        .filter((F.size("_rows") == rate) & (F.col("step") >= skip))
        .select(key, (F.col("step") - skip).alias("step"), F.transform("_rows", lambda r: r[values]).alias(values))
    )


def unstacked(frames: DataFrame, key: str, pos: str, rate: int) -> DataFrame:
    """``(key, step, rows, reason)`` of the groups ``frame_stack`` has no place for, before its first steps are left out."""
    group = F.floor(F.col(pos) / rate).cast("bigint")
    counted = frames.groupBy(key, group.alias("step")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.filter(F.col("rows") != rate).withColumn("reason", F.lit("incomplete group"))


# ---- runs and segments -----------------------------------------------------------------
def merge_unit_blocks(labels: Column) -> Column:
    """Starts of the label runs after every run of length one has joined its shorter neighbour.

    The fold goes from left to right over one slice's small array: each step either moves on or
    removes one border, so twice as many steps as labels are enough.
    """
    n = F.size(labels)
    place = F.sequence(F.lit(0), n - 1)
    starts = F.filter(place, lambda i: (i == 0) | ~F.get(labels, i).eqNullSafe(F.get(labels, i - 1)))
    far = F.lit(2**31 - 1)

    def step(s: Column, _: Column) -> Column:
        b, at = s["b"], s["at"]
        gap = lambda i: F.get(b, i + 1) - F.get(b, i)
        before = F.when(at > 0, gap(at - 1)).otherwise(far)
        after = F.when(at + 2 < F.size(b), gap(at + 1)).otherwise(far)
        gone = F.when(before <= after, at).otherwise(at + 1)
        state = lambda borders, i: F.struct(borders.alias("b"), i.alias("at"))
        return (
            F.when((F.size(b) <= 2) | (at >= F.size(b) - 1), state(b, at))
            .when(gap(at) != 1, state(b, at + 1))
            .otherwise(state(F.filter(b, lambda x, i: i != gone), at))
        )

    first = F.struct(F.concat(starts, F.array(n)).alias("b"), F.lit(0).alias("at"))
    borders = F.aggregate(F.sequence(F.lit(1), 2 * n), first, step)["b"]
    return F.slice(borders, 1, F.size(borders) - 1).cast("array<bigint>")


def slice_blocks(frames: DataFrame, key: str, pos: str, label: str, units: int = 18, length: int = 150) -> DataFrame:
    """Label runs of every slice of ``units`` labels, unit runs merged, rescaled to ``length`` frames.

    A shorter last slice keeps the scale and ends where its labels end.
    """
    grouped = (
        frames.groupBy(key, F.floor(F.col(pos) / units).cast("bigint").alias("slice_idx"))
        .agg(F.array_sort(F.collect_list(F.struct(pos, label))).alias("_rows"))
        .select(key, "slice_idx", F.transform("_rows", lambda r: r[label]).alias("_labels"))
    )
    starts = grouped.select(key, "slice_idx", merge_unit_blocks(F.col("_labels")).alias("_starts"), F.size("_labels").alias("_n"))
    blocks = rescale_blocks(F.col("_starts"), units, length, F.col("_n"))
    return starts.select(key, "slice_idx", F.posexplode(blocks).alias("motion", "_s")).select(
        key, "slice_idx", F.col("motion").cast("bigint").alias("motion"), "_s.*"
    )


def rescale_blocks(starts: Column, units: int = 18, length: int = 150, last: Column | None = None) -> Column:
    """Starts in units to ``array<struct<start_frame,end_frame>>``; the last block ends after ``last`` units, all by default."""
    frame = lambda s: F.bround(s * float(length) / float(units), 0).cast("bigint")
    scaled = F.transform(starts, frame)
    end = F.lit(length).cast("bigint") if last is None else frame(last)
    ends = F.concat(F.slice(scaled, 2, F.greatest(F.size(scaled) - 1, F.lit(0))), F.array(end))
    return F.zip_with(scaled, ends, lambda s, e: F.struct(s.alias("start_frame"), e.alias("end_frame")))


def globalize(slices: DataFrame, step: int = 15, min_len: int = 1) -> DataFrame:
    """Slice-local segments on the global timeline; originals kept; too short ones dropped."""
    shift = F.col("slice_idx") * step
    out = slices.filter(F.col("end_frame") - F.col("start_frame") >= min_len)
    cols = {
        "original_start": F.col("start_frame"),
        "original_end": F.col("end_frame"),
        "start_frame": F.col("start_frame") + shift,
        "end_frame": F.col("end_frame") + shift,
    }
    if "key_frame" in slices.columns:
        keys = F.coalesce("key_frame", F.array().cast("array<bigint>"))
        cols["key_frame"] = F.transform(keys, lambda k: k + shift)
    return out.withColumns(cols)


def cover_or_next(points: DataFrame, segments: DataFrame, key: str, at: str, cols: list[str], width: int = 256,
                  chunk: int = seq.CHUNK) -> DataFrame:
    """Per point: the latest-starting segment over it, else the earliest later one.

    Ties on the start go to the larger end (cover) or the smaller end (next).  ``points`` has
    unique ``(key, at)``.
    """
    payload = F.struct("start_frame", "end_frame", *cols)
    segs = segments.select(key, "start_frame", "end_frame", payload.alias("_seg"))
    hit = interval_join(
        points.select(key, at), segs, [key], F.col(at), F.col("start_frame"), F.col("end_frame") - 1,
        (F.col("start_frame") <= F.col(at)) & (F.col(at) < F.col("end_frame")), width,
    )
    cover = hit.groupBy(key, at).agg(F.max("_seg").alias("_cover"))
    # next: the first start after the point, from one combined timeline of starts and points
    starts = segs.groupBy(key, F.col("start_frame").alias(at)).agg(F.min("_seg").alias("_first"))
    line = points.select(key, at).withColumn("_q", F.lit(True)).join(starts, [key, at], "full")
    later = line.withColumn("_after", F.lit(None).cast("boolean"))
    filled = seq.fill(later.drop("_after"), [key], at, "_first", "_next", ahead=True, chunk=chunk).filter("_q")
    return points.join(by_merge(cover), [key, at], "left").join(by_merge(filled.select(key, at, "_next")), [key, at], "left").select(
        *points.columns, F.coalesce("_cover", "_next").alias("chosen"), F.col("_cover").isNotNull().alias("covered")
    )


def greedy_timeline(segments: DataFrame, key: str, min_step: int = 10, chunk: int = seq.CHUNK) -> DataFrame:
    """One gapless timeline per video from overlapping global segments.

    The walk always moves from a frame to the end of one segment that is fixed by that frame: a
    segment starting there (lowest slice, then motion), else ``cover_or_next``.  So the frames a
    walk can visit form a forest, and the visited ones are found by pointer doubling: joins over
    all videos at once, the number of rounds growing with the logarithm of the longest walk.
    Results shorter than ``min_step`` frames are added to their predecessor.  Segments without a frame are passed over.
    """
    # read six times below
    segments = by_merge(checkpointed(
        segments.select(key, "slice_idx", "motion", "start_frame", "end_frame").filter(F.col("end_frame") > F.col("start_frame"))
    ))
    order = F.struct("slice_idx", "motion")
    tag = F.struct("end_frame", "slice_idx", "motion")
    ends = segments.select(key, F.col("end_frame").alias("at")).distinct()
    nodes = ends.unionByName(segments.select(key, F.lit(0).cast("bigint").alias("at"))).distinct()
    exact = segments.groupBy(key, F.col("start_frame").alias("at")).agg(F.min_by(tag, order).alias("_exact"))
    chosen = cover_or_next(nodes, segments, key, "at", ["slice_idx", "motion"], chunk=chunk)
    best = F.coalesce(
        F.col("_exact"), F.struct(*[F.col(f"chosen.{c}").alias(c) for c in ("end_frame", "slice_idx", "motion")])
    )
    step = chosen.join(exact, [key, "at"], "left").withColumn("_b", best)
    jump = by_merge(checkpointed(
        step.filter(F.col("_b.end_frame").isNotNull()).select(
            key, "at", F.col("_b.end_frame").alias("to"), F.col("_b.slice_idx").alias("slice_idx"),
            F.col("_b.motion").alias("motion"),
        )
    ))
    # longest possible walk: the number of nodes of one video (a single number)
    most = jump.groupBy(key).count().agg(F.max("count")).first()[0] or 1
    rounds = max(1, math.ceil(math.log2(most + 1)))
    hops = [jump.select(key, "at", "to")]
    for _ in range(rounds - 1):
        last = hops[-1]
        nxt = last.select(key, F.col("at").alias("to"), F.col("to").alias("_far"))
        hops.append(by_merge(checkpointed(last.join(nxt, [key, "to"]).select(key, "at", F.col("_far").alias("to")))))
    visited = jump.select(key).distinct().withColumn("at", F.lit(0).cast("bigint"))
    for hop in reversed(hops):
        # each node stays and adds the node one hop ahead; distances differ, so no node repeats
        visited = visited.join(hop, [key, "at"], "left").select(
            key, F.explode(F.array_compact(F.array("at", "to"))).alias("at")
        )
    path = checkpointed(
        visited.join(jump, [key, "at"]).select(
            key, F.col("at").alias("start_frame"), F.col("to").alias("end_frame"), "slice_idx", "motion"
        )
    )
    # every segment but the first opens a new result only if it is long enough
    opens = path.filter((F.col("start_frame") == 0) | (F.col("end_frame") - F.col("start_frame") >= min_step))
    stop = path.groupBy(key).agg(F.max("end_frame").alias("_stop"))
    closed = seq.with_next(opens, [key], "start_frame", {"_next": "start_frame"}, chunk)
    return checkpointed(
        closed.join(by_merge(stop), key).select(
            key, "start_frame", F.coalesce("_next", "_stop").alias("end_frame"), "slice_idx", "motion"
        )
    )


# ---- beats and bars --------------------------------------------------------------------
def nth_downbeat_segments(downbeats: DataFrame, durations: DataFrame, key: str, every: int = 4) -> DataFrame:
    """Bars from every Nth downbeat; the first one is moved to 0, the last bar ends with the media."""
    numbered = scan(downbeats.select(key, "t"), [key], ["t"], {"_n": Scan("sum", F.lit(1), inclusive=False)})
    n = F.coalesce("_n", F.lit(0))
    marks = numbered.filter(n % every == 0).select(
        key, F.floor(n / every).cast("bigint").alias("bar"), F.when(n == 0, 0.0).otherwise(F.col("t")).alias("start_sec"))
    closed = scan(marks, [key], ["bar"], {"_next": following(F.col("start_sec"))})
    return closed.join(durations.select(key, "duration"), key).select(
        key, "bar", "start_sec", F.coalesce("_next.v", "duration").alias("end_sec")
    )


def bar_bucketing(captions: DataFrame, bars: DataFrame, key: str, fps: float = 30.0) -> DataFrame:
    """Assign captions (in timeline order) to bars, which follow one another.

    Walking the captions, one that starts at or after the current bar's end closes exactly that
    bar and opens the next, and one that straddles the end is dropped.  With ``m`` bar ends at or
    before the start of caption ``i``, the caption is in bar ``min(bar(i - 1) + 1, m)``.  Along one
    timeline of bar ends (+1) and captions (-1) that is ``i + 1 + min(0, low)``, where ``low`` is the
    least running sum so far: one scan, without a walk.
    """
    ms = lambda c: F.round(c * 1000000).cast("bigint")
    caption = F.struct(*captions.columns)
    line = captions.select(key, ms(F.col("start_frame") / fps).alias("_at"), F.lit(1).alias("_kind"), F.col("end_frame").alias("_end"),
                           caption.alias("_caption")).unionByName(
        bars.select(key, ms(F.col("end_sec")).alias("_at"), F.lit(0).alias("_kind")), allowMissingColumns=True)
    step = F.when(F.col("_kind") == 0, 1).otherwise(-1)
    seen = scan(line, [key], ["_at", "_kind", "_end"], {
        "_i": Scan("sum", F.col("_kind"), inclusive=False), "_low": Scan("low", step), "_before": Scan("low", step, inclusive=False)})
    least = lambda c: F.least(F.coalesce(c, F.lit(0)), F.lit(0))
    placed = seen.filter("_kind = 1").select(
        "_caption", (F.coalesce("_i", F.lit(0)) + 1 + least(F.col("_low"))).alias("bar"), (least(F.col("_low")) == least(F.col("_before"))).alias("_opens"))
    ends = bars.select(F.col(key).alias("_key"), F.col("bar").alias("_bar"), "end_sec")
    out = placed.join(by_merge(ends), (F.col(f"_caption.{key}") == F.col("_key")) & (F.col("bar") == F.col("_bar")), "left")
    # the caption that opens a bar stays even if it runs over the bar's end
    inside = (F.col("_caption.end_frame") / fps <= F.col("end_sec")) | (F.col("_opens") & (F.col("bar") > 0))
    reason = F.when(F.col("end_sec").isNull(), "after_last_bar").when(inside, "").otherwise("straddles_bar_end")
    bar = F.when(F.col("end_sec").isNotNull() | (F.col("bar") > 0), F.col("bar"))
    return out.select(*[F.col("_caption")[c].alias(c) for c in captions.columns], bar.alias("bar"), reason.alias("dropped"))


def bars_containing(captions: DataFrame, bars: DataFrame, key: str, fps: float = 30.0, width: float = 8.0) -> DataFrame:
    """Stateless variant: captions wholly inside a bar."""
    caps = captions.withColumns({"_s": F.col("start_frame") / fps, "_e": F.col("end_frame") / fps})
    inside = (F.col("_s") >= F.col("start_sec")) & (F.col("_e") <= F.col("end_sec"))
    joined = interval_join(caps, bars, [key], F.col("_s"), F.col("start_sec"), F.col("end_sec"), inside, width)
    return joined.select(*captions.columns, "bar")


def events_in_slices(beats: DataFrame, slices: DataFrame, key: str, step: float = 0.5, length: float = 4.8,
                     bins: int = 144) -> DataFrame:
    """Beats of every slice ``[k*step, k*step + length)`` with their frame index in the slice.

    The slices of a beat follow from its time, so the range join becomes an explode and an
    equi-join with the slices that exist.
    """
    t = F.col("t")
    first = F.greatest(F.floor((t - length) / step), F.lit(0))
    ks = _span(first, F.floor(t / step) + 1)
    cand = beats.select(key, "t", F.explode(ks).alias("slice_idx"))
    rel = t - F.col("slice_idx") * step
    inside = cand.filter((t >= F.col("slice_idx") * step) & (t < F.col("slice_idx") * step + length))
    index = F.least(F.greatest(F.floor(rel / length * bins), F.lit(0)), F.lit(bins - 1)).cast("bigint")
    return inside.join(slices.select(key, "slice_idx").distinct(), [key, "slice_idx"]).select(
        key, "slice_idx", "t", index.alias("frame_index")
    )


def time_to_index(times: DataFrame, durations: DataFrame, key: str, bins: int = 144) -> DataFrame:
    """Times up to the duration as clipped indices of ``bins`` equal parts."""
    d = F.col("duration")
    kept = times.join(durations.select(key, "duration"), key).filter((d > 0) & (F.col("t") <= d + 1e-8))
    index = F.least(F.greatest(F.floor(F.col("t") / d * bins), F.lit(0)), F.lit(bins - 1)).cast("bigint")
    return kept.select(*times.columns, index.alias("frame_index"))


def nearest_beats(music: DataFrame, motion: DataFrame, key: str, pos: str) -> DataFrame:
    """Per music beat the squared distance to the nearest motion beat (null without any).

    As-of in both directions over one combined timeline: linear, one exchange, no pairs.  Repeated beats count once.
    """
    line = music.select(key, pos, F.lit(True).alias("_m")).unionByName(motion.select(key, pos, F.lit(False).alias("_m")))
    beat, asked = F.when(~F.col("_m"), F.col(pos)), F.when(F.col("_m"), F.col(pos))
    # motion beats sort before music beats of the same place, so the way back sees them
    both = scan(line, [key], [pos, "_m"], {
        "_prev": Scan("last", beat), "_next": Scan("last", beat, ahead=True), "_same": Scan("last", asked, inclusive=False)})
    sq = lambda c: (F.col(c) - F.col(pos)) * (F.col(c) - F.col(pos))
    first = F.col("_m") & ~F.coalesce(F.col("_same") == F.col(pos), F.lit(False))
    return both.filter(first).select(key, pos, F.least(sq("_prev"), sq("_next")).alias("distance_sq"))


def chords_in_ranges(ranges: DataFrame, chords: DataFrame, key: str, order: str, width: float = 8.0) -> DataFrame:
    """Chords wholly inside each range joined with ``-`` in time order (empty text without any)."""
    inside = (F.col("chord_start") >= F.col("start_sec")) & (F.col("chord_end") <= F.col("end_sec"))
    hit = interval_join(
        chords, ranges.select(key, order, "start_sec", "end_sec"), [key], F.col("chord_start"),
        F.col("start_sec"), F.col("end_sec"), inside, width,
    )
    listed = F.array_sort(F.collect_list(F.struct("chord_start", "chord")))
    text = hit.groupBy(key, order).agg(F.array_join(F.transform(listed, lambda c: c["chord"]), "-").alias("chords"))
    return ranges.join(by_merge(text), [key, order], "left").select(*ranges.columns, F.coalesce("chords", F.lit("")).alias("chords"))


# ---- segments against frames and windows -----------------------------------------------
def frames_in_segments(frames: DataFrame, segments: DataFrame, key: str, pos: str, text: str, width: int = 256) -> DataFrame:
    """Segment text active at each frame: first by (start, end), half-open, empty in gaps."""
    segs = segments.select(key, "start_frame", "end_frame", text)
    hit = interval_join(
        frames.select(key, pos), segs, [key], F.col(pos), F.col("start_frame"), F.col("end_frame") - 1,
        (F.col("start_frame") <= F.col(pos)) & (F.col(pos) < F.col("end_frame")), width,
    )
    first = hit.groupBy(key, pos).agg(F.min(F.struct("start_frame", "end_frame", text)).alias("_s"))
    return frames.join(first, [key, pos], "left").select(*frames.columns, F.coalesce(f"_s.{text}", F.lit("")).alias(text))


def segments_in_windows(segments: DataFrame, lengths: DataFrame, key: str, length: str, interval: int, move: int) -> DataFrame:
    """Segments (30 fps) wholly inside 60 fps windows: ``2*start >= i`` and ``2*end < i + interval``.

    The windows of a segment are an arithmetic range, so nothing is range-joined.
    """
    s, e = F.col("start_frame") * 2, F.col("end_frame") * 2
    first = F.greatest(F.floor((e - interval) / move) + 1, F.lit(0))
    last = F.least(F.floor(s / move), F.floor((F.col(length) - interval) / move))
    out = segments.join(lengths.select(key, length), key).withColumn("_w", F.explode(_span(first, last)))
    start = F.col("_w") * move
    return out.select(
        *[c for c in segments.columns if c not in ("start_frame", "end_frame")],
        start.alias("window_start"), (s - start).alias("start_frame"), (e - start).alias("end_frame"),
    )


# fixed values: which text domains each half of the body may look at
PART_DOMAINS = {
    "up": ("upper_body", "torso", "whole_body", "simple_tag"),
    "down": ("lower_body", "torso", "whole_body", "simple_tag"),
}
DOMAINS = ("upper_body", "lower_body", "torso", "whole_body", "simple_tag")
MASK_ALIASES = {
    "full": "full", "time_only": "time_only", "part_only": "part_only", "none": "none",
    "no_body_mask": "time_only", "no_temporal_mask": "part_only", "no_mask": "none",
}


def mask_mode(raw: Column) -> Column:
    """Canonical mask mode; anything unknown is ``full``."""
    table = F.create_map(*[F.lit(x) for pair in MASK_ALIASES.items() for x in pair])
    return F.coalesce(table[raw], F.lit("full"))


def token_overlap(segments: DataFrame, windows: DataFrame, key: str, tokens: int, mode: str,
                  domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """Motion tokens each segment's text is visible to, per body half and enabled domain.

    ``segments(key, window, idx, start_frame, end_frame)`` on 60 fps frames; ``windows(key,
    window, window_token)`` gives the first token of each window.  ``full`` and ``time_only``
    restrict to overlapping tokens, ``full`` and ``part_only`` to the half's own domains.
    """
    rules = [
        (part, d)
        for part in PART_DOMAINS
        for d in DOMAINS
        if d in domains and (mode in ("time_only", "none") or d in PART_DOMAINS[part])
    ]
    table = segments.sparkSession.createDataFrame(rules, "part string, domain string")
    if mode in ("full", "time_only"):
        first = F.greatest(F.lit(0), F.floor(F.col("start_frame") / 8) - F.col("window_token"))
        last = F.least(F.lit(tokens), F.floor(F.col("end_frame") / 8) - F.col("window_token")) - 1
    else:
        first, last = F.lit(0), F.lit(tokens - 1)
    seen = segments.join(windows, [key, "window"]).select(
        key, "window", "idx", F.explode(_span(first, last)).alias("token")
    )
    # at most ten rules
    return seen.join(F.broadcast(table))


# ---- resampling ------------------------------------------------------------------------
def upsample_2x(frames: DataFrame, keys: list[str], pos: str, values: list[str], chunk: int = seq.CHUNK) -> DataFrame:
    """T rows to 2T - 1 by midpoints."""
    nxt = {f"_n_{c}": (lambda w, c=c: F.lead(c).over(w)) for c in values}
    ahead = seq.windowed(frames.select(*keys, pos, *values), keys, pos, nxt, after=1, chunk=chunk)
    pair = F.array(
        F.struct((F.col(pos) * 2).alias(pos), *[F.col(c).alias(c) for c in values]),
        F.when(
            F.col(f"_n_{values[0]}").isNotNull(),
            F.struct(
                (F.col(pos) * 2 + 1).alias(pos),
                *[((F.col(c) + F.col(f"_n_{c}")) / 2).alias(c) for c in values],
            ),
        ),
    )
    return ahead.select(*keys, F.explode(F.array_compact(pair)).alias("_r")).select(*keys, "_r.*")


def downsample_half(frames: DataFrame, pos: str) -> DataFrame:
    return frames.filter(F.col(pos) % 2 == 0).withColumn(pos, (F.col(pos) / 2).cast("bigint"))


def downsample_ticks(frames: DataFrame, pos: str, source_fps: float, target_fps: float) -> DataFrame:
    """First frame at or after each tick of ``target_fps`` (source rate at least as high)."""
    tick = lambda f: F.floor((f / source_fps + 1e-9) * target_fps)
    p = F.col(pos)
    return frames.filter((p == 0) | (tick(p) > tick(p - 1))).withColumn("tick", tick(p).cast("bigint"))


def integrate_velocity(frames: DataFrame, keys: list[str], pos: str, value: str, out: str) -> DataFrame:
    """Running sum of the previous velocities, starting at 0."""
    summed = scan(frames, keys, [pos], {out: Scan("sum", F.col(value), inclusive=False)})
    return summed.withColumn(out, F.coalesce(out, F.lit(0.0)))


# ---- sampling plans --------------------------------------------------------------------
def uniform_clip_plan(media: DataFrame, duration: str, clip: float, n: int, skip_head: float) -> DataFrame:
    """``n`` evenly spaced clip starts between the skipped head and the last full clip; else one."""
    d = F.col(duration)
    max_start = F.greatest(F.lit(0.0), d - clip)
    lo = F.least(F.lit(skip_head), max_start)
    single = (d <= clip) | F.lit(n <= 1) | (max_start <= lo + 1e-6)
    only = F.when(d > 0, lo).otherwise(0.0)
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(max(n, 2) - 1)), lambda i: lo + (max_start - lo) * i / float(max(n, 2) - 1)
    )
    return media.select(
        *media.columns, F.posexplode(F.when(single, F.array(only)).otherwise(spread)).alias("clip_no", "clip_start")
    )


def frame_sample_plan(media: DataFrame, n_frames: str, fps: float, every: float, limit: int, skip_head: float) -> DataFrame:
    """Frames to sample: skip the head, step by seconds, at most ``limit``."""
    skip, step = int(skip_head * fps), max(1, int(every * fps))
    last = F.least(F.col(n_frames) - 1, F.lit(skip + (limit - 1) * step))
    return media.select(*media.columns, F.explode(_span(F.lit(skip), last, step)).alias("frame"))


def analysis_slice(duration: Column, length: float = 30.0) -> Column:
    """Start of the analysed slice: a quarter in, moved back if it would run past the end."""
    quarter = F.greatest(F.lit(0.0), duration * 0.25)
    back = F.greatest(F.lit(0.0), duration - length)
    return F.when(duration <= length, 0.0).when(quarter + length > duration, back).otherwise(quarter)


def systematic_sample(df: DataFrame, pos: str, total: int, size: int) -> DataFrame:
    """Rows at positions ``floor(i * total / size)``; ``pos`` is dense from 0."""
    step = total / size
    i = F.ceil(F.col(pos) / step)
    near = lambda j: (F.floor(j * step) == F.col(pos)) & (j >= 0) & (j < size)
    # the only candidates for i sit around pos / step
    return df.filter(near(i - 1) | near(i) | near(i + 1))
