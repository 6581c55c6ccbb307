"""Sequence names: parsing, renaming, lists and code lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------
GENRE_BY_CODE = {
    "mBR": "Break", "mPO": "Pop", "mLO": "Lock", "mWA": "Waack", "mMH": "Middle Hip-hop",
    "mLH": "LA-style Hip-hop", "mHO": "House", "mKR": "Krump", "mJS": "Street Jazz", "mJB": "Ballet Jazz",
}
MUSIC_NUMBERS = range(6)
TEMPO = (80, 10)  # first music id of a genre, step to the next
TEMPO_HOUSE = (110, 5)
# --- end of fixed values ------------------------------------------------------------------


def lookup_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """``(genre_code, genre)`` and ``(music_id, bpm)``; ten and sixty rows."""
    genres = spark.createDataFrame(list(GENRE_BY_CODE.items()), "genre_code string, genre string")
    rows = []
    for code in GENRE_BY_CODE:
        first, step = TEMPO_HOUSE if code == "mHO" else TEMPO
        rows += [(f"{code}{i}", first + step * i) for i in MUSIC_NUMBERS]
    return genres, spark.createDataFrame(rows, "music_id string, bpm bigint")


def parse_sequence_name(df: DataFrame, name: str) -> DataFrame:
    """genre, style, camera, dancer, music, take and slice (0 without one) of a sequence name."""
    parts = F.split(F.col(name), "_")
    part = lambda i: F.get(parts, F.lit(i))
    slice_part = F.regexp_extract(F.col(name), r"_slice(\d+)", 1)
    return df.withColumns(
        {
            "genre_code": part(0), "style": part(1), "camera": part(2), "dancer": part(3),
            "music": part(4), "take": part(5),
            "slice_idx": F.when(slice_part == "", 0).otherwise(slice_part.cast("bigint")).cast("bigint"),
        }
    )


def to_all_cameras(name: Column) -> Column:
    return F.replace(name, F.lit("_c01_"), F.lit("_cAll_"))


def to_first_camera(name: Column) -> Column:
    return F.replace(name, F.lit("_cAll_"), F.lit("_c01_"))


def allow_list(df: DataFrame, allowed: DataFrame, name: str) -> DataFrame:
    """Rows whose canonical name is on the list."""
    listed = allowed.select(to_all_cameras(F.col(name)).alias("_canonical")).distinct()
    return (
        df.withColumn("_canonical", to_all_cameras(F.col(name)))
        .join(listed, "_canonical", "left_semi").select(*df.columns)
    )


def eligible_takes(df: DataFrame, name: str, prefix: str = "g", inside: bool = True, prefer_second: bool = False) -> DataFrame:
    """Names with (or without) the corpus prefix; optionally drop a first take when a second exists."""
    starts = F.startswith(F.col(name), F.lit(prefix))
    out = df.filter(starts if inside else ~starts)
    if prefer_second:
        second = df.select(F.replace(F.col(name), F.lit("ch02"), F.lit("ch01")).alias(name)).join(
            df.filter(F.contains(F.col(name), F.lit("ch02"))).select(
                F.replace(F.col(name), F.lit("ch02"), F.lit("ch01")).alias(name)), name, "left_semi").distinct()
        out = out.filter(~F.contains(F.col(name), F.lit("ch01"))).unionByName(
            out.filter(F.contains(F.col(name), F.lit("ch01"))).join(second, name, "left_anti").select(*out.columns)
        )
    return out


def code_lookup(df: DataFrame, music: str, default_genre: str = "any") -> DataFrame:
    """Genre name (with a default) and tempo (null when unknown) of a music id such as ``mBR0``."""
    genres, tempo = lookup_tables(df.sparkSession)
    # both tables are fixed and tiny, so they are broadcast
    keyed = df.withColumns({"genre_code": F.substring(music, 1, 3), "music_id": F.col(music)})
    return keyed.join(F.broadcast(genres), "genre_code", "left").join(F.broadcast(tempo), "music_id", "left").select(
        *df.columns, F.coalesce("genre", F.lit(default_genre)).alias("genre"), "bpm"
    )


def split_union(train: DataFrame, tests: Sequence[DataFrame], known: DataFrame, key: str) -> DataFrame:
    """Ids tagged train / test, known ids only; the validation list counts as test."""
    out = train.select(key, F.lit("train").alias("split"))
    for t in tests:
        out = out.unionByName(t.select(key, F.lit("test").alias("split")))
    return out.join(known.select(key).distinct(), key, "left_semi")


def slice_thinning(files: DataFrame, base: str, slice_idx: str) -> DataFrame:
    """Drop slice k (not a multiple of ten) when the next multiple of ten exists for the same base."""
    tens = files.filter(F.col(slice_idx) % 10 == 0).select(base, F.col(slice_idx).alias("_ten")).distinct()
    nxt = F.when(F.col(slice_idx) % 10 != 0, (F.floor(F.col(slice_idx) / 10) + 1) * 10)
    return files.withColumn("_ten", nxt.cast("bigint")).join(tens, [base, "_ten"], "left_anti").select(*files.columns)
