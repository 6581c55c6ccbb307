"""Toxicity by compression distance between two zstandard dictionaries."""

from __future__ import annotations

from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import hashed_share, id_remainder, labelled_sample, per_text, table

#: Labelled rows the dictionaries and thresholds are fitted on, at most about.
TOXIC_ROWS = 1500
ORDINARY_ROWS = 2500
WINDOW_WORDS = 4
BASE_BYTES = 16 << 10
TOXIC_BYTES = 4 << 10
HARD_BYTES = 4 << 10
LEVEL = 13
#: Stands at the start of every window and the end of both dictionaries: every frame then has a match, and a
#: further match costs the same in a short window as in a long one.
CARRIER = b"\x01carrier of every window\x02"


def windows(text: str | None) -> list[bytes]:
    """The lower-cased words of a whole text, four at a time, with a blank on both sides."""
    words = (text or "").lower().split()
    return [f" {' '.join(words[i : i + WINDOW_WORDS])} ".encode("utf-8", "surrogatepass") for i in range(0, len(words), WINDOW_WORDS)]


class Gauge:
    """Bytes by which the toxic dictionary compresses windows better than the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.content = (ordinary, toxic)
        self.pair = None

    def __getstate__(self) -> dict:
        return {"content": self.content, "pair": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state

    def __call__(self, texts: list[bytes]) -> list[int]:
        if self.pair is None:
            self.pair = [self._compressor(self.content[0]), self._compressor(self.content[1] + self.content[0])]
        ordinary, toxic = (c.compress for c in self.pair)
        return [len(ordinary(CARRIER + w)) - len(toxic(CARRIER + w)) for w in texts]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        content += CARRIER
        kind = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=0, write_dict_id=0, write_checksum=0, dict_size=len(content), source_size=128
        )
        return zstandard.ZstdCompressor(dict_data=kind, compression_params=parameters)


def features(gains: list[int]) -> list[float]:
    """What a text's windows say: the largest gain, how many gain clearly, their share, and the length."""
    n, clear = len(gains), sum(g >= 4 for g in gains)
    return [1.0, min(max(gains, default=0), 12) / 4, np.log1p(clear), np.log1p(sum(g >= 6 for g in gains)),
            np.sqrt(clear / (n + 5)) * 4, np.log1p(n) / 5]


def _pieces(word: str) -> set[str]:
    marked = f"_{word}_"
    return {marked[i : i + n] for n in (4, 5, 6, 7) for i in range(len(marked) - n + 1)}


def _telling_words(toxic: list[str], ordinary: list[str]) -> Counter:
    """Words of toxic texts with a piece that ordinary texts hardly have, and in how many texts they stand."""
    counted = []
    for texts in (toxic, ordinary):
        found: Counter = Counter()
        for text in texts:
            pieces: set[str] = set()
            for word in set(text.lower().split()):
                pieces |= _pieces(word)
            found.update(pieces)
        counted.append(found)
    n, m = max(1, len(toxic)), max(1, len(ordinary))
    telling = set()
    for piece, c in counted[0].items():
        if c >= 4:
            a, b = c / n, (counted[1][piece] + 0.5) / (m + 1)
            if a > 20 * b and a - b > 3 * np.sqrt(a * (1 - a) / n + b * (1 - b) / m):
                telling.add(piece)
    words: Counter = Counter()
    for text in toxic:
        words.update(w for w in set(text.lower().split()) if not telling.isdisjoint(_pieces(w)))
    return words


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; the samples themselves where there are too few to train on."""
    try:
        raw = zstandard.train_dictionary(size, samples).as_bytes()
        return raw[max(0, raw.find(b" ", 128)) :]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.5) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), slope)
    return w


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id",
    toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, seed: int = 3,
) -> dict:
    """Dictionaries and calibration from a bounded sample of labelled rows, drawn by a hash of the key.

    Three fifths of the sample train the dictionaries.  The ordinary one is trained on windows of ordinary
    texts.  The toxic one holds the same content, so ordinary passages compress alike in both, and before it
    what is trained on the words of toxic texts whose pieces ordinary texts hardly have.  Ordinary windows that
    still gain are put into the ordinary content as well.  The rest of the sample calibrates how gains turn
    into a probability.  Equal texts count once.  Without toxic or ordinary rows every score is the share of
    toxic rows (0 without any).
    """
    sample, sizes = labelled_sample(docs, labels, key, label, {1: toxic_rows, 0: ordinary_rows}, seed)
    drawn = sample.filter(F.col(text).isNotNull()).select(
        F.col(text).alias("t"), F.col(label).alias("y"), (hashed_share(F.col(text), seed=seed + 1) < 0.6).alias("a")
    ).distinct().collect()
    drawn.sort(key=lambda r: (r.y, r.a, r.t))
    part = lambda y, a: [r.t for r in drawn if r.y == y and r.a == a]
    toxic, ordinary = part(1, True), part(0, True)
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    if not toxic or not ordinary or not part(0, False) or not part(1, False):
        return {"gauge": None, "weights": None, "prior": float(prior)}
    rng = np.random.default_rng(seed)
    plain = [w for t in ordinary for w in windows(t)]
    plain = [plain[i] for i in rng.permutation(len(plain))]
    base = _dictionary(plain[:60_000], BASE_BYTES)
    words = _telling_words(toxic, ordinary)
    samples = [f" {w} ".encode() for w, n in sorted(words.items(), key=lambda x: (-x[1], x[0])) for _ in range(min(n, 40))]
    special = _dictionary([samples[i] for i in rng.permutation(len(samples))], TOXIC_BYTES) if samples else b""
    first = Gauge(base, special)
    tried = plain[-60_000:]
    hard = sorted({w for w, g in zip(tried, first(tried)) if g >= 3})
    hard = [hard[i] for i in rng.permutation(len(hard))]
    gauge = Gauge(b"".join(hard)[:HARD_BYTES] + base, special)
    x, y, weight = [], [], []
    for label_value in (0, 1):
        for t in part(label_value, False):
            x.append(features(gauge(windows(t))))
            y.append(label_value)
    return {"gauge": gauge, "weights": _logistic(np.array(x), np.array(y, float)),
            "shift": float(np.log(prior / (1 - prior)) - np.log(np.mean(y) / (1 - np.mean(y)))), "prior": float(prior)}


def score(text: Column, model: dict) -> Column:
    """``struct(score, gain)`` of whole texts: a probability in 0..1 and the largest gain of a window in bytes.

    Null, empty and blank texts have no window and get the score of a text without any gain.
    """
    gauge, weights = model["gauge"], model["weights"]

    def rate(texts: list) -> list:
        if gauge is None:
            return [(model["prior"], 0)] * len(texts)
        out = []
        for t in texts:
            gains = gauge(windows(t))
            logit = float(np.dot(features(gains), weights)) + model["shift"]
            out.append((1 / (1 + float(np.exp(-min(30.0, max(-30.0, logit))))), max(gains, default=0)))
        return out

    return per_text("score double, gain int", rate, text)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = fit(documents, labels.filter(~held_out))
    return documents.select("doc_id", held_out.alias("held_out"), score(F.col("text"), model).alias("_s")).select(
        "doc_id", "held_out", "_s.score", (F.col("_s.score") >= 0.5).cast("int").alias("predicted"), "_s.gain"
    )
