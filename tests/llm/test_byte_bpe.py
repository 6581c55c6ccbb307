"""Packed token ids against a plain merge loop and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import functions as F

from cadenza.llm import byte_bpe

SPLIT = regex.compile(public_tokenizers.PATTERN)


def merged(ranks, raw):
    """Lowest rank first, leftmost first."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 30), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def plain(ranks, text):
    return [i for m in SPLIT.findall(text) for i in ([ranks[m.encode()]] if m.encode() in ranks else merged(ranks, m.encode()))]


def texts():
    rng = random.Random(5)
    alphabet = ["a", "Be", "ß", "é", "1", "22", "'s", "'", "!", "...", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", " ", " ", "　", "漢字", "🙂", "👩‍👩‍👧", "\x00"]
    mixed = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(150)]
    runs = [a + s * n + b for a in ("", "x", "'") for b in ("", "s", "!", "1") for s in (" ", "\n", "\t ", " ") for n in (999, 1000, 1001)]
    return [*mixed, *runs, "", "<|endoftext|> it's we'LL"]


def test_ids_equal_a_plain_merge_loop_and_the_uncut_library(spark, monkeypatch):
    vocabulary = byte_bpe.Vocabulary.load()
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.ranks.splitlines())}
    whole, _ = vocabulary.encoders()
    for cut, run in ((1, 2), (7, 3), (1 << 16, 1000)):
        monkeypatch.setattr(byte_bpe, "CUT_CHARS", cut)
        monkeypatch.setattr(byte_bpe, "LONG_RUN", run)
        monkeypatch.setattr(byte_bpe, "_RUN", regex.compile(f"[{byte_bpe._SPACE}]{{{run},}}"))
        for text in texts():
            ids = vocabulary.encode(text).tolist()
            assert ids == whole.encode_ordinary(text), repr(text)
            if len(text) < 200:
                assert ids == plain(ranks, text)
            assert vocabulary.decode(np.array(ids, "<u4")) == text.encode()


def test_every_kind_of_row(spark, tmp_path):
    long = [" " * 3_000_000 + "x", "a" * 1_000_000, "word " * 400_000, "\n" * 2_000_000]
    rows = [(i, t) for i, t in enumerate([*texts(), *long, None])] + [(None, "null id"), (1, "again"), (1, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("own"), "raw": F.lit(1)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = byte_bpe.op12_byte_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    vocabulary = byte_bpe.Vocabulary.load()
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = [(i, len(ids), sha(ids.astype("<u4").tobytes()), sha((t or "").encode()))
            for i, t in rows for ids in [vocabulary.encode(t or "")]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_packed_ids_unpack_and_broken_ones_give_null(spark):
    vocabulary = byte_bpe.Vocabulary.load()
    rows = spark.createDataFrame([("it's",), ("",), (None,)], "text string")
    ids = rows.select("text", byte_bpe.encode(F.col("text"), vocabulary).alias("ids"))
    got = ids.select("text", byte_bpe.unpack(F.col("ids")).alias("n"), byte_bpe.decode(F.col("ids"), vocabulary).alias("raw")).collect()
    assert [(r.text, r.n, None if r.raw is None else bytes(r.raw)) for r in got] == [
        ("it's", vocabulary.encode("it's").tolist(), b"it's"), ("", [], b""), (None, None, None)]
    broken = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"\xff\xff\xff\x7f"),)], "ids binary")
    assert all(r[0] is None for r in broken.select(byte_bpe.decode(F.col("ids"), vocabulary)).collect())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert byte_bpe.op12_byte_bpe(spark, str(tmp_path)).collect() == []
