"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import hashed_share, id_remainder, per_text, table

DIMENSIONS = 4096
#: Labelled rows a model is fitted on, over all languages.
SAMPLE_ROWS = 2400
CENTROIDS = 4
UNKNOWN = "und"

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """1 for every code point that is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    return _LETTERS


def ngram_counts(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Hashed counts of letter pairs and triples, word borders included; ``None`` without a letter."""
    if not text:
        return None
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(32)).astype(np.uint64)
    # runs of other characters count as one border
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    if len(codes) < 3:
        return None
    pairs = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    triples = pairs[:-1] * np.uint64(31) + codes[2:] * np.uint64(0x165667B19E3779F9)
    shift, size = np.uint64(40), np.uint64(dimensions)
    cells = np.concatenate(((pairs >> shift) % size, (triples >> shift) % size)).astype(np.int64)
    return np.bincount(cells, minlength=dimensions)


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.log1p(counts) * idf
    norm = np.sqrt((weights * weights).sum(axis=-1, keepdims=True))
    return weights / np.where(norm > 0, norm, 1)


def _cluster(vectors: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """Unit centroids of spherical k-means; as many as there are distinct rows at most."""
    centres = vectors[[rng.integers(len(vectors))]]
    while len(centres) < min(k, len(vectors)):
        far = np.clip(1 - (vectors @ centres.T).max(axis=1), 0, None) ** 2
        if far.sum() <= 1e-12:
            break
        centres = np.vstack([centres, vectors[rng.choice(len(vectors), p=far / far.sum())]])
    near = None
    for _ in range(rounds):
        now = (vectors @ centres.T).argmax(axis=1)
        if near is not None and (now == near).all():
            break
        near = now
        for c in range(len(centres)):
            if (near == c).any():
                mean = vectors[near == c].mean(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


def fit(
    rows: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    dimensions: int = DIMENSIONS,
    sample_rows: int = SAMPLE_ROWS,
    centroids: int = CENTROIDS,
    seed: int = 7,
) -> dict:
    """Centroids per language from at most about ``sample_rows`` labelled rows, the same number of each language.

    Rows are drawn by a hash of the key; whole texts are used.  Rows without a language or a letter
    are passed over.  Without any row the model knows no language and rejects everything.
    """
    labelled = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    each = max(1, sample_rows // max(1, len(sizes)))
    share = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(each / n))]) if sizes else F.lit(0.0)
    drawn = labelled.filter(hashed_share(F.col(key), F.col(text), seed=seed) < (share[F.col(lang)] if sizes else share))

    def vectors(texts: list) -> list:
        found = [ngram_counts(t, dimensions) for t in texts]
        return [(None if v is None else v.astype(np.float32).tobytes(),) for v in found]

    got = (
        drawn.select(F.col(lang).alias("lang"), per_text("v binary", vectors, F.col(text)).alias("_v"))
        .select("lang", "_v.v").filter("v IS NOT NULL").toPandas()
    )
    got = got.sort_values(["lang", "v"])
    if not len(got):
        return {"langs": [], "owner": np.zeros(0, int), "centres": np.zeros((0, dimensions), np.float32),
                "idf": np.ones(dimensions, np.float32), "least": np.zeros(0), "dimensions": dimensions}
    counts = np.vstack([np.frombuffer(v, np.float32) for v in got["v"]])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.1
    vecs, names = _tfidf(counts, idf), got["lang"].to_numpy()
    rng = np.random.default_rng(seed)
    langs = sorted(set(names))
    parts = [_cluster(vecs[names == name], centroids, rng) for name in langs]
    # a text farther from its best centroid than nearly all of the language's own rows is rejected
    least = [float(np.quantile((vecs[names == name] @ c.T).max(axis=1), 0.005)) for name, c in zip(langs, parts)]
    return {"langs": langs, "owner": np.repeat(np.arange(len(langs)), [len(p) for p in parts]),
            "centres": np.vstack(parts).astype(np.float32), "idf": idf.astype(np.float32),
            "least": np.array(least), "dimensions": dimensions}


def predict(text: Column, model: dict) -> Column:
    """``struct(lang_pred, score, rejected)`` of whole texts.

    ``score`` is the cosine with the nearest centroid, cut to 0..1.  Null, empty and letterless texts give
    ``und``, 0 and a rejection.  ``rejected`` marks texts farther from every centroid than the language's
    own rows; they still carry the nearest language.  Of equally near languages the first in order wins.
    """
    centres, langs, owner, idf, least = (model[k] for k in ("centres", "langs", "owner", "idf", "least"))
    dimensions = model["dimensions"]

    def classify(texts: list) -> list:
        out: list = [(UNKNOWN, 0.0, True)] * len(texts)
        found = [(i, v) for i, v in ((i, ngram_counts(t, dimensions)) for i, t in enumerate(texts)) if v is not None]
        if found and langs:
            cosines = _tfidf(np.array([v for _, v in found], np.float32), idf) @ centres.T
            best = cosines.argmax(axis=1)
            for (i, _), b, row in zip(found, best, cosines):
                score = float(min(1.0, max(0.0, row[b])))
                out[i] = (langs[owner[b]], score, score < least[owner[b]])
        return out

    return per_text("lang_pred string, score double, rejected boolean", classify, text)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = fit(documents.filter(~held_out))
    return documents.select("doc_id", held_out.alias("held_out"), predict(F.col("text"), model).alias("_p")).select(
        "doc_id", "held_out", "_p.*"
    )
