"""The curation job: candidates in, scored and labelled candidates out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, CurationConfig
from cadenza.operators import curation as cur


def unique_passed(
    items: DataFrame, cfg: CurationConfig = DEFAULT, key: str = "bvid", pos: str = "pos", columns: list[str] | None = None
) -> DataFrame:
    """Gate first, then keep the first passed record per key (later stages never see the rest).

    ``columns`` names what later stages need; the rest (titles above all) stays out of the shuffle.
    """
    passed = cur.metadata_gate(items, cfg).filter("metadata_filter_pass")
    return cur.first_per_key(passed if columns is None else passed.select(key, pos, *columns), key, pos)


def score_and_fuse(
    unique: DataFrame, solo: DataFrame, audio: DataFrame, media_key: str, cfg: CurationConfig = DEFAULT
) -> DataFrame:
    """Join vision and audio results and fuse.  Keys without a result count as unchecked."""
    joined = unique.join(solo.withColumn("vision_checked", F.lit(True)), media_key, "left").join(
        audio.withColumn("audio_checked", F.lit(True)), media_key, "left"
    )
    filled = joined.withColumns(
        {
            "vision_checked": F.coalesce("vision_checked", F.lit(False)),
            "audio_checked": F.coalesce("audio_checked", F.lit(False)),
            "solo_score": F.coalesce("solo_score", F.lit(0.0)),
            "solo_label": F.coalesce("solo_label", F.lit("")),
            "audio_score": F.coalesce("audio_score", F.lit(0.0)),
            "audio_label": F.coalesce("audio_label", F.lit("")),
            "speech_ratio": F.col("speech"),
        }
    )
    return cur.fuse(filled, cfg)
