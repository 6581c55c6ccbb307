"""Candidate curation: typed records, gates, scores, fusion, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, CurationConfig
from cadenza.functions import texts as tx
from cadenza.operators import sequence as seq


# ---- typed records ---------------------------------------------------------------------
def normalize_items(raw: DataFrame, query: str | Column) -> DataFrame:
    """Raw search rows to typed candidate columns."""
    scheme_less = (F.col("pic") != "") & ~F.startswith("pic", F.lit("http"))
    tag_list = F.filter(F.transform(F.split("tag", ","), lambda t: F.trim(t)), lambda t: t != "")
    return raw.select(
        F.coalesce(F.col("bvid"), F.lit("")).alias("bvid"),
        F.coalesce(F.col("aid").cast("string"), F.lit("")).alias("aid"),
        tx.strip_markup(F.col("title")).alias("title"),
        F.col("author").alias("uploader"),
        F.col("duration").alias("duration_str"),
        tx.duration_seconds(F.col("duration")).alias("duration_sec"),
        F.col("pubdate").cast("bigint").alias("publish_ts"),
        F.coalesce(F.replace("play", F.lit(","), F.lit("")).try_cast("bigint"), F.lit(0)).alias("view_count"),
        F.when(scheme_less, F.concat(F.lit("https:"), "pic")).otherwise(F.col("pic")).alias("cover_url"),
        F.coalesce(F.col("typeid").try_cast("bigint"), F.lit(0)).alias("tid"),
        F.col("typename").alias("tid_name"),
        F.coalesce(tag_list, F.array().cast("array<string>")).alias("tags"),
        (F.lit(query) if isinstance(query, str) else query).alias("search_query"),
    )


# ---- metadata gates --------------------------------------------------------------------
def _all_hits(text: Column, cfg: CurationConfig, white: list[str], black: list[str]) -> Column:
    """One search for each distinct word; genres and their words follow from the white list's hits."""
    genres = sorted(cfg.genres)
    none = F.array().cast("array<string>")
    listed = lambda words: F.array(*[F.lit(w) for w in words])
    searched = F.transform(F.array(F.lower(text)), lambda low: F.struct(
        tx.keyword_hits(low, white).alias("white"), tx.keyword_hits(low, black).alias("black"),
        tx.keyword_hits(low, cfg.audio_boost).alias("boost"), tx.keyword_hits(low, cfg.audio_penalty).alias("penalty"),
    ))
    words = sorted({w for g in genres for w in cfg.genres[g]})
    hit = lambda h: [F.when(F.arrays_overlap(h["white"], listed(cfg.genres[g])), F.lit(g)) for g in genres if cfg.genres[g]]
    return F.get(F.transform(searched, lambda h: F.struct(
        h["white"].alias("_white"), h["black"].alias("_black"), h["boost"].alias("_boost"), h["penalty"].alias("_penalty"),
        (F.array_compact(F.array(*hit(h))) if hit(h) else none).alias("_genres"),
        (F.array_intersect(listed(words), h["white"]) if words else none).alias("_words"),
    )), F.lit(0))


def metadata_gate(items: DataFrame, cfg: CurationConfig = DEFAULT) -> DataFrame:
    """All metadata rules as one projection.

    Adds pass flag, score, matched genres/keywords and the list of reasons.  A record stops at
    the first rule that rejects it: duration, views, black list, then penalty words; genres are
    already filled when a penalty word rejects.  Reasons name a few words of each list, the columns
    ``whitelist_hits``, ``blacklist_hits``, ``boost_hits`` and ``penalty_hits`` hold all of them.
    """
    genre_words = [w for g in cfg.genres.values() for w in g]
    white = sorted(set(cfg.whitelist) | set(genre_words))
    black = sorted(set(cfg.blacklist))
    text = F.concat(F.col("title"), F.lit(" "), F.array_join("tags", " "))
    # the generator evaluates the text search once per row; as plain columns the optimizer would
    # copy it into every expression and pushed-down filter that uses a hit list
    hits = items.select("*", F.inline(F.array(_all_hits(text, cfg, white, black))))
    early = (
        F.when(
            F.col("duration_sec") < cfg.min_duration_sec,
            F.format_string(f"REJECT:duration_too_short(%.0fs < {cfg.min_duration_sec:.0f}s)", "duration_sec"),
        )
        .when(
            F.col("duration_sec") > cfg.max_duration_sec,
            F.format_string(f"REJECT:duration_too_long(%.0fs > {cfg.max_duration_sec:.0f}s)", "duration_sec"),
        )
        .when(
            F.col("view_count") < cfg.min_view_count,
            F.format_string(f"REJECT:view_count_too_low(%d < {cfg.min_view_count})", "view_count"),
        )
        .when(
            F.size("_black") > 0,
            F.concat(F.lit("REJECT:blacklist_hit("), tx.first_n(F.col("_black"), 5), F.lit(")")),
        )
    )
    n_white, n_genre, n_boost = F.size("_white"), F.size("_genres"), F.size("_boost")
    white_score = F.when(n_white > 0, F.least(F.lit(1.0), n_white / 3.0)).otherwise(0.1)
    genre_score = F.least(F.lit(1.0), n_genre * 0.5)
    boost_score = F.when(n_boost > 0, F.least(F.lit(1.0), 0.7 + 0.3 * n_boost)).otherwise(0.5)
    ww, wg, wa = cfg.weight_whitelist, cfg.weight_genre, cfg.weight_audio_words
    score = (white_score * ww + genre_score * wg + boost_score * wa) / (ww + wg + wa)
    judged = hits.withColumns({"_early": early, "_late": F.size("_penalty") > 0})
    passed = F.col("_early").isNull() & ~F.col("_late")
    judged = judged.withColumns(
        {
            "metadata_filter_pass": passed,
            "metadata_score": F.when(passed, tx.python_round(score, 4)).otherwise(0.0),
            "matched_genres": F.when(F.col("_early").isNull(), F.col("_genres")).otherwise(
                F.array().cast("array<string>")
            ),
            "matched_keywords": F.when(F.col("_early").isNull(), F.col("_words")).otherwise(
                F.array().cast("array<string>")
            ),
        }
    )
    listed = lambda head, hit, n, tail=")": F.concat(F.lit(head), tx.first_n(F.col(hit), n), F.lit(tail))
    reasons = F.array(
        F.when(n_white > 0, listed("PASS:whitelist_hit(", "_white", 5)).otherwise("WARN:no_whitelist_keyword_hit"),
        F.when(n_genre > 0, listed("PASS:genre_hit(", "_genres", 5)).otherwise("INFO:no_genre_matched"),
        F.when(F.col("_late"), listed("REJECT:audio_penalty_hit(", "_penalty", 3)).when(
            n_boost > 0, listed("AUDIO_BOOST:", "_boost", 3, "")
        ),
        F.when(F.col("metadata_filter_pass"), F.format_string("metadata_score=%.3f", "metadata_score")),
    )
    judged = judged.withColumn(
        "metadata_filter_reasons",
        F.when(F.col("_early").isNotNull(), F.array("_early")).otherwise(F.array_compact(reasons)),
    )
    all_hits = {"_white": "whitelist_hits", "_black": "blacklist_hits", "_boost": "boost_hits", "_penalty": "penalty_hits"}
    return judged.withColumnsRenamed(all_hits).drop("_genres", "_words", "_early", "_late")


# ---- duplicates ------------------------------------------------------------------------
def first_per_key(records: DataFrame, key: str, pos: str) -> DataFrame:
    """First record per key, in input order.

    ``min_by`` combines map-side, so a key held by a third of all rows costs one row per task.
    """
    rest = [c for c in records.columns if c != key]
    packed = F.struct(*rest)
    return (
        records.groupBy(key)
        .agg(F.min_by(packed, pos).alias("_first"))
        .select(*[F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in records.columns])
    )


def duplicate_map(records: DataFrame, key: str) -> DataFrame:
    """Keys seen more than once with their canonical key and the number of removed rows."""
    return (
        records.groupBy(key)
        .agg((F.count(F.lit(1)) - 1).alias("removed"))
        .filter("removed > 0")
        .select(F.col(key), F.col(key).alias("canonical"), "removed")
    )


# ---- scores per candidate --------------------------------------------------------------
def person_stats(detections: DataFrame, key: str) -> DataFrame:
    """Share of frames with at least one / exactly one / several persons and mean largest area."""
    n = F.col("person_count")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return detections.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_frames"),
        share(n >= 1).alias("valid_ratio"),
        share(n == 1).alias("single_ratio"),
        share(n >= 2).alias("crowded_ratio"),
        F.coalesce(F.avg(F.when(n >= 1, F.col("area"))), F.lit(0.0)).alias("avg_area"),
    )


def motion_score(detections: DataFrame, key: str, pos: str = "frame", chunk: int = seq.CHUNK) -> DataFrame:
    """Motion estimate from the frames with exactly one person; null under five of them."""
    single = detections.filter((F.col("person_count") == 1) & F.col("cx").isNotNull())
    single = single.select(key, pos, "cx", "cy", "area")
    steps = seq.with_previous(single, [key], pos, {"_px": "cx", "_py": "cy"}, chunk)
    moved = F.hypot(F.abs(F.col("cx") - F.col("_px")), F.abs(F.col("cy") - F.col("_py")))
    stats = steps.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(moved).alias("_step"), F.stddev_pop("area").alias("_spread")
    )
    score = 0.7 * F.least(F.lit(1.0), F.col("_step") / 0.06) + 0.3 * F.least(F.lit(1.0), F.col("_spread") / 0.05)
    return stats.select(key, F.when(F.col("_n") >= 5, tx.python_round(score, 4)).alias("motion_score"))


def solo_score(keys: DataFrame, detections: DataFrame, key: str, cfg: CurationConfig = DEFAULT) -> DataFrame:
    """One scored row per key of ``keys``; keys without any detection row are ``no_person``."""
    stats = person_stats(detections, key).join(motion_score(detections, key), key, "left")
    area = F.least(F.lit(1.0), F.col("avg_area") / 0.20)
    raw = F.when(F.col("motion_score").isNotNull(), area * 0.5 + F.col("motion_score") * 0.5).otherwise(area)
    good = tx.python_round(raw, 4)
    crowd_limit = cfg.max_crowded_ratio
    joined = keys.select(key).distinct().join(stats, key, "left").withColumn("_good", good)
    no_rows = F.col("n_frames").isNull()
    few = F.col("valid_ratio") < cfg.min_valid_person_ratio
    crowded = F.col("crowded_ratio") > crowd_limit
    score = (
        F.when(no_rows, 0.0)
        .when(few, 0.05)
        .when(crowded, F.greatest(F.lit(0.0), 0.4 - (F.col("crowded_ratio") - crowd_limit) * 1.5))
        .otherwise(F.col("_good"))
    )
    label = (
        F.when(no_rows | few, "no_person")
        .when(crowded, "likely_multi")
        .when(F.col("_good") >= cfg.solo_threshold, "likely_solo")
        .when(F.col("_good") >= cfg.uncertain_threshold, "uncertain")
        .otherwise("likely_multi")
    )
    rounded = {c: tx.python_round(F.col(c), 4) for c in ("valid_ratio", "single_ratio", "crowded_ratio", "avg_area")}
    return joined.select(
        key,
        *[rounded[c].alias(c) for c in rounded],
        "motion_score",
        score.alias("solo_score"),
        label.alias("solo_label"),
    )


def audio_gate(stats: DataFrame, cfg: CurationConfig = DEFAULT) -> DataFrame:
    """Ordered audio checks; the first failure names the label, later statistics keep their defaults."""
    checks = [
        ("insufficient_audio", F.col("present") < cfg.min_audio_present_ratio),
        ("low_loudness", F.col("loudness") < cfg.min_loudness_mean),
        ("high_clipping", F.col("clipping") > cfg.max_clipping_ratio),
        ("low_snr", F.col("snr") < cfg.min_snr_proxy),
        ("speech_heavy", F.col("speech") > cfg.speech_ratio_max),
    ]
    if cfg.min_music_conf is not None:
        checks.append(("weak_music_evidence", F.col("music") < cfg.min_music_conf))
    step = F.lit(None).cast("int")
    for i, (_, failed) in reversed(list(enumerate(checks))):
        step = F.when(failed, i).otherwise(step)
    labels = F.array(*[F.lit(n) for n, _ in checks])
    out = stats.withColumn("_step", F.coalesce(step, F.lit(len(checks))))
    reached = lambda i, c, default, digits: F.when(
        F.col("_step") >= i, tx.python_round(F.col(c), digits)
    ).otherwise(default)
    passed = F.col("_step") == len(checks)
    cols = {
        "present": reached(0, "present", 0.0, 4),
        "loudness": reached(1, "loudness", -60.0, 2),
        "stability": reached(1, "stability", 0.0, 4),
        "clipping": reached(2, "clipping", 0.0, 4),
        "snr": reached(3, "snr", 0.0, 2),
        "speech": reached(4, "speech", 0.0, 4),
        "music": reached(5, "music", 0.0, 4),
        "audio_score": F.when(passed, 1.0).otherwise(0.0),
        "audio_label": F.when(passed, "clear_music").otherwise(F.get(labels, F.col("_step"))),
    }
    kept = [c for c in stats.columns if c not in cols]
    return out.select(*kept, *[c.alias(n) for n, c in cols.items()])


# ---- fusion ----------------------------------------------------------------------------
def fuse(records: DataFrame, cfg: CurationConfig = DEFAULT) -> DataFrame:
    """Weighted final score and keep / review / drop.

    Needs ``metadata_filter_pass, metadata_score, vision_checked, solo_score, solo_label,
    audio_checked, audio_score, audio_label, speech_ratio`` (speech may be null).
    """
    solo = F.when(F.col("vision_checked"), F.col("solo_score")).otherwise(0.5)
    audio = F.when(F.col("audio_checked"), F.col("audio_score")).otherwise(0.5)
    ws, wa, wm = cfg.weight_solo, cfg.weight_audio, cfg.weight_metadata
    raw = (solo * ws + audio * wa + F.col("metadata_score") * wm) / (ws + wa + wm)
    scored = records.withColumns({"_solo": solo, "_audio": audio}).withColumn("final_score", tx.python_round(raw, 4))
    final, keep, drop = F.col("final_score"), cfg.keep_threshold, cfg.drop_threshold
    noisy_keep = F.col("audio_checked") & (F.coalesce("speech_ratio", F.lit(0.0)) > cfg.speech_ratio_max)
    rescue = (
        F.lit(cfg.unstable_vision_audio_rescue)
        & (F.col("solo_label") == "uncertain")
        & (F.col("_audio") >= cfg.audio_threshold)
        & (final >= drop)
    )
    rules = [
        ("metadata_filter_failed", "drop", ~F.col("metadata_filter_pass")),
        ("likely_multi+low_score", "drop", (F.col("solo_label") == "likely_multi") & (final < drop)),
        ("no_person+poor_audio", "drop", (F.col("solo_label") == "no_person") & (F.col("_audio") < 0.3)),
        ("speech_heavy_but_good_solo", "review",
         (F.col("audio_label") == "speech_heavy") & (F.col("_solo") > cfg.solo_threshold)),
        ("uncertain_vision_but_good_audio", "review", rescue),
        ("vision_unchecked+good_metadata", "review", ~F.col("vision_checked") & (F.col("metadata_score") > 0.6)),
        ("good_score_but_high_speech", "review", (final >= keep) & noisy_keep),
        ("keep_threshold", "keep", final >= keep),
        ("drop_threshold", "review", final >= drop),
    ]
    verdict, reason = F.lit("drop"), F.lit("below_drop_threshold")
    for name, result, holds in reversed(rules):
        held = F.coalesce(holds, F.lit(False))
        verdict = F.when(held, result).otherwise(verdict)
        reason = F.when(held, name).otherwise(reason)
    return scored.withColumns({"final_recommendation": verdict, "fusion_rule": reason}).drop("_solo", "_audio")


# ---- summaries -------------------------------------------------------------------------
def _count_if(condition: Column) -> Column:
    return F.count_if(condition)


def query_summary(records: DataFrame) -> DataFrame:
    rec = F.col("final_recommendation")
    name = F.when(F.coalesce("search_query", F.lit("")) == "", "unknown").otherwise(F.col("search_query"))
    return records.groupBy(name.alias("search_query")).agg(
        F.count(F.lit(1)).alias("total"),
        _count_if(F.col("metadata_filter_pass")).alias("metadata_passed"),
        *[_count_if(rec == r).alias(r) for r in ("keep", "review", "drop")],
    )


def genre_coverage(records: DataFrame) -> DataFrame:
    rec = F.col("final_recommendation")
    return (
        records.select("final_recommendation", F.explode("matched_genres").alias("genre"))
        .groupBy("genre")
        .agg(
            F.count(F.lit(1)).alias("total_matched"),
            _count_if(rec == "keep").alias("keep"),
            _count_if(rec == "review").alias("review"),
        )
    )


def duration_summary(records: DataFrame) -> DataFrame:
    """Count, total and mean duration over all records and per recommendation; empty buckets stay."""
    sec = F.greatest(F.lit(0.0), F.col("duration_sec"))
    sums = (
        records.rollup("final_recommendation")
        .agg(F.count(F.lit(1)).alias("count"), F.sum(sec).alias("_sum"), F.grouping("final_recommendation").alias("_all"))
        .select(F.when(F.col("_all") == 1, "all").otherwise(F.col("final_recommendation")).alias("split"), "count", "_sum")
    )
    spark = records.sparkSession
    splits = spark.createDataFrame([("all",), ("keep",), ("review",), ("drop",)], "split string")
    n, total = F.coalesce("count", F.lit(0)), F.coalesce("_sum", F.lit(0.0))
    mean = F.when(n > 0, total / n).otherwise(0.0)
    return splits.join(sums, "split", "left").select(
        "split",
        n.cast("bigint").alias("count"),
        tx.python_round(total, 2).alias("total_duration_sec"),
        tx.python_round(total / 3600.0, 4).alias("total_duration_hours"),
        tx.python_round(mean, 2).alias("avg_duration_sec"),
        tx.python_round(mean / 60.0, 2).alias("avg_duration_min"),
    )


def status_counts(records: DataFrame, status: Column, passed: Column) -> DataFrame:
    """Rows per status with the overall pass rate in percent."""
    counts = records.groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("_passed")
    )
    # the status table has a handful of rows
    every = Window.partitionBy(F.lit(0))
    rate = 100.0 * F.sum("_passed").over(every) / F.greatest(F.sum("n").over(every), F.lit(1))
    return counts.select("status", "n", tx.python_round(rate, 1).alias("pass_rate"))


# ---- order and selection ---------------------------------------------------------------
def rank_by_score(records: DataFrame, score: str, pos: str) -> DataFrame:
    """Rank by descending score, ties in input order."""
    return seq.number_all(records, [F.desc(score), F.col(pos)], "rank", start=1)


def running_total_cutoff(
    records: DataFrame, key: str, pos: str, value: str, target: float, chunk: int = seq.CHUNK
) -> DataFrame:
    """First-seen keys in input order until the running total reaches ``target`` (crossing row kept)."""
    unique = first_per_key(records, key, pos)
    if target <= 0:
        return unique.withColumn("running_total", F.lit(None).cast("double"))
    total = seq.running(unique, [], pos, value, "running_total", "sum", True, chunk)
    return total.filter(F.col("running_total") - F.col(value) < target)


def fetch_selection(records: DataFrame, cfg: CurationConfig = DEFAULT, force_all: bool = False) -> DataFrame:
    """Records still to fetch: allowed label, score floor, not present locally (``local_path`` null)."""
    absent = F.col("local_path").isNull()
    if force_all:
        return records.filter(absent)
    rec = F.col("final_recommendation")
    wanted = rec != "drop"
    if not cfg.download_keep:
        wanted = wanted & (rec != "keep")
    if not cfg.download_review:
        wanted = wanted & (rec != "review")
    if cfg.download_min_fusion_score > 0:
        wanted = wanted & (F.col("final_score") >= cfg.download_min_fusion_score)
    return records.filter(wanted & absent)
