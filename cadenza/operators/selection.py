"""Selecting and aligning whole sequences: caps, lists, modalities, lengths, frame rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def length_cap(pairs: DataFrame, length: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of at most ``most``, and a report ``(bucket, n, rate)`` of kept and dropped rows; a null length is dropped."""
    fits = F.coalesce(F.col(length) <= most, F.lit(False))
    counted = pairs.agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("dropped"), F.count(F.lit(1)).alias("_all"))
    line = lambda name: F.struct(
        F.lit(name).alias("bucket"), F.col(name).alias("n"), F.round(F.coalesce(F.col(name) / F.nullif("_all", F.lit(0)), F.lit(0.0)), 6).alias("rate"))
    return pairs.filter(fits), counted.select(F.explode(F.array(line("kept"), line("dropped"))).alias("r")).select("r.*")


def rescale_frames(frame: Column, factor: int = 2, origin: int | Column = 0) -> Column:
    """Frame number at ``factor`` times the rate, counted from ``origin``."""
    return frame * factor - origin


def seconds_to_frames(seconds: Column, rate: float = 30.0) -> Column:
    """Nearest frame, ties to even."""
    return F.bround(seconds * rate, 0).cast("bigint")


def cap_per_group(rows: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """First ``n`` rows of every group.

    The rank filter runs inside every task before the shuffle, so at most ``n`` rows per group and task travel.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def ignore_list(items: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """Items whose key is not on the list; items without a key stay, nulls on the list mean nothing."""
    return items.join(bad.select(key).distinct(), key, "left_anti")


def modality_inner(motion: DataFrame, meta: DataFrame, music: DataFrame, item: str, name: str) -> DataFrame:
    """Motion rows with their text data and the music their name holds as last token but one; a missing side drops the row."""
    keyed = motion.withColumn("music", F.split_part(name, F.lit("_"), F.lit(-2)))
    return keyed.join(meta, item).join(music, "music")


def align_lengths(a: DataFrame, b: DataFrame, key: str, pos: str) -> DataFrame:
    """Rows of two sequences side by side, each cut to the shorter one."""
    return a.join(b, [key, pos])


def segment_times(parts: DataFrame, segments: DataFrame, song: str, number: str) -> DataFrame:
    """Generated parts with the times of the original segment of their number; numbers out of range drop."""
    return parts.join(segments, [song, number])
