"""Trained classifiers: held-out accuracy, the linear-time identity, and rows of every odd kind."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import language, quality, toxicity
from cadenza.llm.common import id_remainder, per_text
SF = "/root/testdata/sf0.001"

ODD = [(None, None), (1, ""), (2, " \n\t"), (3, "a"), (3, "a"), (4, "word " * 20_000), (5, "€ß🙂 ▁")]


def odd(spark):
    # columns whose names clash with those the operators make
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns(
        {"score": F.lit("own"), "lang_pred": F.lit(7), "n_chars": F.lit(None).cast("long"), "predicted": F.lit(1)})


def test_fold_matches_crc32(spark):
    got = spark.range(50).select("id", id_remainder(F.col("id"), 5).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_pairwise_identity():
    rng = np.random.default_rng(0)
    model = {"b": 0.3, "w": rng.normal(size=40), "v": rng.normal(size=(40, 5))}
    rows = [(np.sort(rng.choice(40, n, replace=False)), rng.normal(size=n)) for n in (1, 4, 9)]
    ids, values, starts = quality._laid_out(rows)
    for (i, x), got in zip(rows, quality.raw_scores(ids, values, starts, model)):
        pairs = sum(model["v"][i[a]] @ model["v"][i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert np.isclose(got, model["b"] + model["w"][i] @ x + pairs, atol=1e-4)


def test_quality_on_held_out_rows(spark):
    folder = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = id_remainder(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, labels.filter(~held))
    rows = docs.join(labels.filter(held), "doc_id").select("quality", quality.score(F.col("text"), model, (F.col("n_chars"),)).score.alias("s")).collect()
    assert rows and np.mean([(r.s >= 0.3) == r.quality for r in rows]) >= 0.9
    lost = docs.join(labels.filter(held), "doc_id").select("quality", quality.score(F.col("text"), model, (F.lit(None),)).score.alias("s")).collect()
    assert np.mean([(r.s >= 0.3) == r.quality for r in lost]) >= 0.9
    with pytest.raises(ValueError):
        quality.score(F.col("text"), model)
    scores = odd(spark).select(quality.score(F.col("text"), model, (F.col("n_chars"),)).score.alias("s")).collect()
    assert len(scores) == len(ODD) and all(0 <= r.s <= 1 for r in scores) and scores[0] == scores[1] and scores[3] == scores[4]


def test_quality_without_labels(spark):
    docs, none = spark.read.parquet(f"{SF}/documents.parquet").limit(3), spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert {r.s for r in docs.select(quality.score(F.col("text"), model).score.alias("s")).collect()} == {0.5}


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = id_remainder(F.col("doc_id"), 4) == 2
    model = language.fit(docs.filter(~held))
    rows = docs.filter(held).select("lang", language.predict(F.col("text"), model).lang_pred.alias("p")).collect()
    assert rows and np.mean([r.lang == r.p for r in rows]) >= 0.95
    got = odd(spark).select(language.predict(F.col("text"), model).alias("p")).select("p.*").collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and got[0].rejected and got[0].score == 0
    assert got[3] == got[4] and all(0 <= r.score <= 1 for r in got)


def test_language_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert docs.select(language.predict(F.col("text"), model)).count() == 0
    assert odd(spark).select(language.predict(F.col("text"), model).lang_pred.alias("p")).distinct().collect()[0].p == "und"


def toxic_corpus(spark, n=500):
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        words, bad = list(rng.choice(plain, 60)), i % 4 == 0
        if bad:
            for at in rng.integers(0, 60, 3):
                words[at] = ["zgrubblk", "vyxquort", "kjwhoomp"][rng.integers(3)]
        rows.append((i, " ".join(words), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_by_compression(spark):
    rows = toxic_corpus(spark)
    held = id_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(rows.drop("toxic"), rows.filter(~held).select("doc_id", "toxic"))
    got = rows.filter(held).select("toxic", toxicity.score(F.col("text"), model).score.alias("s")).collect()
    assert np.mean([(r.s >= 0.5) == r.toxic for r in got]) >= 0.95
    scores = odd(spark).select(toxicity.score(F.col("text"), model).alias("s")).select("s.*").collect()
    assert all(0 <= r.score <= 1 for r in scores) and scores[0] == scores[1] == scores[2] and scores[3] == scores[4] and scores[0].gain == 0


def test_toxicity_without_a_class(spark):
    rows = toxic_corpus(spark, 40).withColumn("toxic", F.lit(0))
    model = toxicity.fit(rows.drop("toxic"), rows.select("doc_id", "toxic"))
    assert {r.s for r in rows.select(toxicity.score(F.col("text"), model).score.alias("s")).collect()} == {0.0}


def test_per_text_keeps_order_and_cuts_batches(spark):
    docs = spark.range(1000).withColumn("text", F.concat(F.lit("t"), "id"))
    got = docs.select("id", per_text("n int, t string", lambda ts: [(len(ts), t) for t in ts], F.col("text"), rows=7).alias("x")).select("id", "x.*").collect()
    assert all(r.t == f"t{r.id}" and r.n <= 7 for r in got) and len(got) == 1000
