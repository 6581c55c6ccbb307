"""The training loader as one job: aligned sequences in, padded windows with their texts out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators import motion as mo
from cadenza.operators import selection as sel

#: Window schemes and the frames their windows move by; windows that move by one frame carry a training mask.
SCHEMES: dict[str, int] = {"strided": 8, "tumbling": 24, "every": 1}
#: First frames of windows one group holds; it also holds the frames of a window and its padding behind them.
CHUNK = 128


def aligned_sequences(joints: DataFrame, music: DataFrame, motions: DataFrame, meta: DataFrame, key: str, name: str, root: int = 0) -> DataFrame:
    """``(key, frame, motion, music)`` of the sequences that have text data and music, cut to the shorter side.

    ``motions(key, name)`` names the sequences, ``meta(key)`` lists those with text data, ``joints(key, frame, joint,
    x, y, z)`` are their points and ``music(music, frame, value)`` the features of each piece of music, whose name is the
    last token but one of a sequence's name.  ``motion`` holds x, y and z of all joints in order, taken
    relative to the root joint of the frame; a frame without its root joint has nulls.  The one
    window over the joints of a frame and the grouping of its vector use one exchange.
    """
    pieces = music.select("music").distinct()
    usable = sel.modality_inner(motions.select(key, name), meta.select(key).distinct(), pieces, key, name).select(key, "music").distinct()
    moved = mo.relative_to_root(joints.join(usable.select(key), key, "left_semi"), key, root=root)
    points = F.array_sort(F.collect_list(F.struct("joint", F.array("x", "y", "z").alias("at"))))
    vectors = moved.groupBy(key, "frame").agg(F.flatten(F.transform(points, lambda p: p["at"])).alias("motion"))
    heard = music.join(usable, "music").select(key, "frame", F.col("value").alias("music"))
    return sel.align_lengths(vectors, heard, key, "frame")


def window_records(frames: DataFrame, segments: DataFrame, key: str, interval: int = 24, pad: int = 5, rate: int = 2,
                   schemes: Mapping[str, int] = SCHEMES, chunk: int = CHUNK) -> DataFrame:
    """Every full window of all ``schemes``: its frames, its frames with ``pad`` neighbours a side, mask and segments.

    ``frames(key, frame, motion, music)`` has each frame of a sequence once.  A window is full if all its ``interval``
    frames are there; the neighbours end, with zeros, where the sequence ends or has a gap.  ``segments(key,
    motion, start_frame, end_frame)`` count frames ``rate`` times as long; a window lists those wholly inside it, with
    frames counted from its start.  Sequences without segments have empty lists, null keys no window.

    Frames and segments go through one exchange for all schemes: a group holds ``chunk`` first frames of windows and a
    border behind and before them, so it is bounded whatever the length of a sequence, and no sequence length is needed.
    """
    behind = F.floor((F.col("frame") - (interval + pad - 1)) / chunk)
    cells = lambda first, last: F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("bigint"), last.cast("bigint")))
    item = F.struct("frame", "motion", "music")
    placed = frames.filter(F.col(key).isNotNull()).select(
        key, cells(behind, F.floor((F.col("frame") + pad) / chunk)).alias("_chunk"), item.alias("_f"))
    s, e = F.col("start_frame") * rate, F.col("end_frame") * rate
    # windows that hold the segment start between e - interval + 1 and s
    fitting = segments.filter(F.col(key).isNotNull() & (e - interval + 1 <= s) & (s >= 0))
    texts = fitting.select(
        key, cells(F.floor((e - interval + 1) / chunk), F.floor(s / chunk)).alias("_chunk"),
        F.struct(s.alias("start"), e.alias("end"), F.col("motion").alias("motion")).alias("_s"))
    groups = placed.unionByName(texts, allowMissingColumns=True).groupBy(key, "_chunk").agg(
        F.array_sort(F.collect_list("_f")).alias("_f"), F.array_sort(F.collect_list("_s")).alias("_s"))
    at = lambda i: F.get("_f", i)["frame"]
    first = F.col("_chunk") * chunk
    starts = F.filter(
        F.transform("_f", lambda r, i: i),
        lambda i: (at(i) >= first) & (at(i) < first + chunk) & F.coalesce(at(i + interval - 1) == at(i) + interval - 1, F.lit(False)))

    def neighbour(i: Column, o: Column) -> Column:
        zeros = F.transform(F.get("_f", i)["motion"], lambda x: F.lit(0.0))
        return F.when(at(i + o) == at(i) + o, F.get("_f", i + o)["motion"]).otherwise(zeros)

    def window(i: Column) -> Column:
        rows = F.slice("_f", i + 1, interval)
        inside = F.filter("_s", lambda x: (x["start"] >= at(i)) & (x["end"] < at(i) + interval))
        return F.struct(
            at(i).alias("start"), rows["motion"].alias("motion"), rows["music"].alias("music"),
            F.transform(F.sequence(F.lit(-pad), F.lit(interval + pad - 1)), lambda o: neighbour(i, o)).alias("context"),
            F.transform(inside, lambda x: F.struct(
                x["motion"].alias("motion"), (x["start"] - at(i)).alias("start_frame"), (x["end"] - at(i)).alias("end_frame"),
            )).alias("segments"))

    windows = groups.select(key, F.inline(F.transform(starts, window)))
    every = F.array(*[F.struct(F.lit(name).alias("scheme"), F.lit(move).alias("move")) for name, move in schemes.items()])
    chosen = windows.select("*", F.inline(F.filter(every, lambda x: F.col("start") % x["move"] == 0)))
    ones = F.array_repeat(F.lit(1), interval - 2)
    last = F.concat(F.array_repeat(F.lit(0), interval - 3), F.array(F.lit(1)))
    mask = F.when(F.col("move") > 1, F.array_repeat(F.lit(1), interval)).when(F.col("start") == 0, ones).otherwise(last)
    return chosen.select(key, "scheme", "start", "motion", "music", "context", "segments", mask.alias("mask"))
