import pytest
from pyspark.sql import functions as F

from cadenza.config import CurationConfig
from cadenza.functions import texts as tx
from cadenza.operators import curation as cur


def gate(spark, rows, cfg=None):
    df = spark.createDataFrame(rows, "pos bigint, title string, tags array<string>, duration_sec double, view_count bigint")
    return {r.pos: r for r in cur.metadata_gate(df, cfg or CurationConfig()).collect()}


def test_duration_bounds_are_inclusive(spark):
    out = gate(spark, [(i, "街舞 独舞", [], d, 1000) for i, d in enumerate((20.0, 29.9, 30.0, 180.0, 300.0, 9999.0))])
    assert [out[i].metadata_filter_pass for i in range(6)] == [False, False, True, True, True, False]
    assert out[0].metadata_filter_reasons == ["REJECT:duration_too_short(20s < 30s)"]
    assert "duration_too_long" in out[5].metadata_filter_reasons[0]


def test_black_list_in_title_and_tags_and_penalty(spark):
    out = gate(spark, [
        (0, "Reaction 街舞", [], 120.0, 1000), (1, "街舞", ["教学"], 120.0, 1000), (2, "hello", [], 120.0, 1000),
        (3, "hiphop and popping 讲解", [], 120.0, 1000), (4, "hiphop popping live 原声", [], 120.0, 1000),
    ])
    assert not out[0].metadata_filter_pass and "reaction" in out[0].metadata_filter_reasons[0]
    assert not out[1].metadata_filter_pass
    assert out[2].metadata_filter_pass and out[2].metadata_filter_reasons[0] == "WARN:no_whitelist_keyword_hit"
    assert out[2].metadata_score == pytest.approx(0.165)
    # a penalty word rejects after the genres are filled
    assert not out[3].metadata_filter_pass and out[3].matched_genres == ["hiphop", "hoping"] and out[3].metadata_score == 0
    assert out[4].metadata_filter_pass and 0 < out[4].metadata_score <= 1
    assert set(out[4].matched_genres) == {"hiphop", "hoping"}


def test_view_floor_and_overrides(spark):
    with pytest.warns(UserWarning, match="unknown"):
        cfg = CurationConfig.from_json('{"min_view_count": 10, "nonsense": 1}')
    assert not gate(spark, [(0, "街舞", [], 60.0, 9)], cfg)[0].metadata_filter_pass


def test_first_per_key_keeps_input_order(spark):
    df = spark.createDataFrame([(2, "BV1", "second"), (1, "BV1", "first"), (3, "BV2", "only")], "pos int, bvid string, title string")
    assert {r.bvid: r.title for r in cur.first_per_key(df, "bvid", "pos").collect()} == {"BV1": "first", "BV2": "only"}
    assert [tuple(r) for r in cur.duplicate_map(df, "bvid").collect()] == [("BV1", "BV1", 1)]
    assert cur.first_per_key(df.limit(0), "bvid", "pos").count() == 0


@pytest.mark.parametrize("raw,seconds", [("3:25", 205), ("1:02:35", 3755), ("45", 45), ("1:2:3:4", 4), ("x:1", 0), ("", 0), (" 2:03 ", 123)])
def test_durations(spark, raw, seconds):
    assert spark.range(1).select(tx.duration_seconds(F.lit(raw))).first()[0] == seconds


def _frames(none, single, multi, moving=False):
    rows = []
    for i in range(none + single + multi):
        n = 0 if i < none else 1 if i < none + single else 3
        rows.append(("c", i, n, 0.1 * (i % 7) if moving else 0.5, 0.5, 0.3))
    return rows


@pytest.mark.parametrize("mix,label", [
    ((0, 30, 0), "uncertain"), ((0, 0, 30), "likely_multi"), ((30, 0, 0), "no_person"), ((0, 27, 3), "uncertain"),
    ((10, 20, 0), "no_person"), ((0, 15, 15), "likely_multi"),
])
def test_solo_labels(spark, mix, label):
    det = spark.createDataFrame(_frames(*mix), "clip string, frame bigint, person_count int, cx double, cy double, area double")
    keys = spark.createDataFrame([("c",), ("empty",)], "clip string")
    out = {r.clip: r for r in cur.solo_score(keys, det, "clip").collect()}
    assert out["c"].solo_label == label
    assert 0 <= out["c"].solo_score <= 1
    assert out["empty"].solo_label == "no_person" and out["empty"].solo_score == 0


def test_motion_needs_five_single_frames(spark):
    schema = "clip string, frame bigint, person_count int, cx double, cy double, area double"
    few = spark.createDataFrame(_frames(0, 4, 0, True), schema)
    many = spark.createDataFrame(_frames(0, 12, 0, True), schema)
    assert cur.motion_score(few, "clip").first().motion_score is None
    assert cur.motion_score(many, "clip", chunk=3).first().motion_score == cur.motion_score(many, "clip").first().motion_score > 0.5


def test_fusion_rule_order(spark):
    rows = [  # id, pass, meta, vision, solo, solo_label, audio, audio_score, audio_label, speech
        (0, False, 0.9, True, 1.0, "likely_solo", True, 1.0, "clear_music", 0.0, "drop"),
        (1, True, 0.1, True, 0.2, "likely_multi", True, 0.0, "low_snr", 0.0, "drop"),
        (2, True, 0.9, True, 0.05, "no_person", True, 0.0, "low_snr", 0.0, "drop"),
        (3, True, 0.9, True, 0.9, "likely_solo", True, 0.0, "speech_heavy", 0.6, "review"),
        (4, True, 0.9, True, 0.6, "uncertain", True, 1.0, "clear_music", 0.0, "review"),
        (5, True, 0.9, False, 0.0, "", False, 0.0, "", None, "review"),
        (6, True, 0.9, True, 0.9, "likely_solo", True, 1.0, "clear_music", 0.5, "review"),
        (7, True, 0.9, True, 0.9, "likely_solo", True, 1.0, "clear_music", 0.1, "keep"),
        (8, True, 0.2, False, 0.0, "", False, 0.0, "", None, "review"),
    ]
    df = spark.createDataFrame(
        rows, "id int, metadata_filter_pass boolean, metadata_score double, vision_checked boolean, solo_score double, solo_label string, "
        "audio_checked boolean, audio_score double, audio_label string, speech_ratio double, want string")
    for r in cur.fuse(df).collect():
        assert r.final_recommendation == r.want, r


def test_duration_summary_keeps_empty_buckets(spark):
    df = spark.createDataFrame([("keep", 60.0), ("keep", -5.0)], "final_recommendation string, duration_sec double")
    out = {r.split: r for r in cur.duration_summary(df).collect()}
    assert set(out) == {"all", "keep", "review", "drop"}
    assert (out["all"]["count"], out["all"].total_duration_sec, out["drop"]["count"], out["drop"].avg_duration_sec) == (2, 60.0, 0, 0.0)


def test_cutoff_keeps_crossing_row(spark):
    df = spark.createDataFrame([(i, f"k{i // 2}", 10.0) for i in range(20)], "pos bigint, bvid string, sec double")
    kept = cur.running_total_cutoff(df, "bvid", "pos", "sec", 35.0, chunk=3).collect()
    assert sorted(r.bvid for r in kept) == ["k0", "k1", "k2", "k3"]


def test_title_near_dup_with_a_crowded_token_and_a_chain(spark):
    from cadenza.operators import titles

    rng = __import__("random").Random(2)
    rows = [(i, f"boiler plate passage number {rng.randrange(40)} and {i % 13}") for i in range(2500)]
    # a chain: 1 is like 0, 2 like 1, but 2 is not like 0
    words = [f"w{i}" for i in range(24)]
    rows += [(5000, " ".join(words[:20])), (5001, " ".join(words[1:21])), (5002, " ".join(words[3:23])), (5003, "")]
    frame = spark.createDataFrame(rows, "pos long, title string").withColumn("tokens", titles.title_tokens(F.col("title")))
    got = {r.pos: r.duplicate for r in titles.near_duplicates(frame, "pos", "tokens", 0.8).collect()}
    sets = {i: set(t.lower().split()) for i, t in rows}
    kinds: dict = {}
    for i, s in sorted(sets.items()):
        key = frozenset(s)
        near = key in kinds or any(len(s & set(k)) >= 0.8 * len(s | set(k)) for k in kinds)
        kinds.setdefault(key, i)
        assert got[i] == near, i
    assert got[5001] and got[5002] and not got[5000] and not got[5003]
