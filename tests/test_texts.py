import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import captions as cp
from cadenza.operators import titles


@pytest.mark.parametrize("block_rows", [2, 1024])
def test_near_duplicates_match_brute_force(spark, block_rows):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    base = [rng.sample(words, rng.randint(0, 25)) for _ in range(40)]
    # a third of all rows are exact or near copies of one record
    for i in range(30):
        copy = list(base[5])
        if i % 2 and copy:
            copy[rng.randrange(len(copy))] = f"x{i}"
        base.insert(rng.randrange(len(base)), copy)
    rows = list(enumerate(base))
    df = spark.createDataFrame(rows, "pos bigint, tokens array<string>")
    got = {r.pos: r.duplicate for r in titles.near_duplicates(df, "pos", "tokens", 0.85, block_rows).collect()}
    sets = [set(t) for t in base]
    for i, a in enumerate(sets):
        want = any((len(a & b) / len(a | b) if a | b else 1.0) >= 0.85 for b in sets[:i])
        assert got[i] == want, i


def test_title_tokens(spark):
    tok = lambda s: set(spark.range(1).select(titles.title_tokens(F.lit(s))).first()[0])
    assert tok("独舞") == {"独舞"} and {"hiphop", "dance"} == tok("hiphop dance")
    assert {"hiphop", "cover", "街舞"} <= tok("hiphop街舞 cover")
    sim = lambda a, b: spark.range(1).select(titles.jaccard(titles.title_tokens(F.lit(a)), titles.title_tokens(F.lit(b)))).first()[0]
    assert sim("", "") == 1.0 and sim("独舞视频", "") == 0.0 and sim("独舞视频", "独舞视频") == 1.0
    assert sim("hiphop dance cover", "hiphop dance practice") >= 0.5
    assert 0.3 < sim("独舞视频 街舞版", "独舞视频 练习室版") < 0.9


def one(spark, col):
    return spark.range(1).select(col.alias("c")).first()[0]


def test_parse_domains(spark):
    text = "**simple tag**\nside  steps\n\n**Whole Body**\nleans\nforward\n**lower half body**\nhops\n**upper half body**\narms\n**torso**\nleans"
    got = one(spark, cp.parse_domains(F.lit(text)))
    assert got.simple_tag == "side steps" and got.whole_body == "leans forward" and got.torso == "leans"
    assert one(spark, cp.parse_domains(F.lit("**torso:** text"))).torso is None
    assert one(spark, cp.missing_headings(F.lit("**torso** **simple tag**"))) == ["whole body", "lower half body", "upper half body"]


def test_cues_and_prompt(spark):
    got = one(spark, cp.format_cues(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit(0), F.lit(7))))
    assert got.split("\n") == ["* **Pose 1 (sampled at frame 0):** a", "* **Trans 1 (from frame 0 to 7):** b", "* **Pose 2 (sampled at frame 7):** c"]
    assert one(spark, cp.insert_cues(F.lit("q **Your Answer** z **Your Answer** cut"), F.lit("X"))) == "q X\n---\n\n**Your Answer** z "
    assert one(spark, cp.insert_cues(F.lit("q"), F.lit(""))) == "q"


def test_generated_text(spark):
    assert one(spark, cp.extract_answer(F.lit("<think>Segment 1 no</think><answer> yes </answer>"))) == "yes"
    assert one(spark, cp.extract_answer(F.lit("<THINK>plain"))) == "plain"
    body = "**simple tag**: t\n**whole body**: w*x\n**upper body**: u\n**lower body**: l\n**torso**: c\n"
    text = "* **Movement 1 (0.36 - 1.48):**\n" + body + "* **Movement 2 (1.5 – 2):**\n**torso**: only\n" + "* **Movement 3 (2 - 3.05):**\n" + body
    df = spark.createDataFrame([(1, text), (2, "***Movement 1***: 0.00 – 1.40\n" + body), (3, "nothing")], "song int, answer string")
    got = sorted(map(tuple, cp.parse_movements(df, ["song"], "answer").select("song", "movement", "start_frame", "end_frame", "whole_body").collect()))
    assert got == [(1, 0, 11, 44, "w"), (1, 2, 60, 92, "w"), (2, 0, 0, 42, "w")]
    songs = spark.createDataFrame([(1, "Segment 1: 0.0 - 1.0 go\nSEGMENT 2\n: - stay"), (2, " no heads ")], "song int, answer string")
    parts = sorted(map(tuple, cp.parse_song_segments(songs, "song", "answer").collect()))
    assert parts == [(1, 0, 1, "go"), (1, 1, 2, "stay"), (2, 0, 1, "no heads")]
    assert [one(spark, cp.ensure_sentence(F.lit(t))) for t in ("", "a", "a! ")] == ["The choreography continues with matching dynamics.", "a.", "a!"]


def test_reject_whole_file(spark):
    full = "\n".join(f"**{d}**\nx" for d in cp.DOMAINS)
    df = spark.createDataFrame([("a", 0, full), ("a", 1, full), ("b", 0, full), ("b", 1, "**torso**\nx"), ("c", 3, "")], "file string, motion int, response string")
    good, bad = cp.caption_ingest(df, "file", "motion", "response")
    assert {r.file for r in good.collect()} == {"a"}
    reasons = {r.file: r.reason for r in bad.collect()}
    assert set(reasons) == {"b", "c"} and reasons["b"].startswith("motion 1 lacks: whole body") and reasons["c"] == "motion 3 has no modifier"
