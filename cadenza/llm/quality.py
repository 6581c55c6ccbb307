"""Text quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import id_remainder, labelled_sample, per_text, table

#: Labelled rows a model is fitted on, at most about.
TRAIN_ROWS = 6000
WORD_CELLS = 1 << 15
RANK = 8
#: Words whose cell a worker remembers before it starts anew.
REMEMBERED = 200_000

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"!?()-"]] = True
_UPPER, _LOWER, _DIGIT, _SPACE, _POINT = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POINT[[ord(c) for c in ".,;:!?"]] = True


class _Cells(dict):
    """Word -> hash cell, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        cell = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_CELLS
        return cell


_CELLS = _Cells()


def structure(text: str, words: list[str], cells: np.ndarray) -> list[float]:
    """Statistics of the form of a text, each about 0 to 1."""
    codes = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size, n = max(1, int(codes.sum())), max(1, len(words))
    letters = max(1, int(codes[_UPPER | _LOWER].sum()) + int(codes[128:].sum()) // 2)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(np.unique(cells))
    marks = sum(not any(c.isalnum() for c in w) for w in words)
    return [
        codes[_SYMBOLS].sum() / size * 4,
        codes[_UPPER].sum() / letters,
        codes[_DIGIT].sum() / size * 4,
        codes[_SPACE].sum() / size * 2,
        codes[_POINT].sum() / size * 4,
        codes[ord("!")] / n,
        codes[ord("|")] / n,
        marks / n,
        distinct / n,
        float((cells[1:] == cells[:-1]).mean()) if len(cells) > 1 else 0.0,
        float((cells[2:] == cells[:-2]).mean()) if len(cells) > 2 else 0.0,
        min(1.0, sum(map(len, words)) / n / 12),
        len(set(lines)) / max(1, len(lines)),
        min(1.0, np.log1p(n) / 8),
        1.0 if n < 8 else 0.0,
        min(1.0, size / max(1, len(lines)) / 800),
    ]


def featurize(text: str | None, extra: list) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: word cells, then structure statistics, then metadata (not a number where null)."""
    text = text or ""
    words = text.split()
    cells = np.fromiter(map(_CELLS.__getitem__, words), np.int64, len(words))
    ids, counts = np.unique(cells, return_counts=True)
    weights = 1 + np.log(counts)
    weights = weights / max(1e-9, np.sqrt((weights * weights).sum()))
    dense = structure(text, words, cells) + [np.nan if v is None else float(np.log1p(max(0.0, float(v))) / 12) for v in extra]
    return np.concatenate([ids, WORD_CELLS + np.arange(len(dense))]), np.concatenate([weights, dense])


def raw_scores(ids: np.ndarray, values: np.ndarray, starts: np.ndarray, model: dict) -> np.ndarray:
    """Factorisation machine of rows laid end to end.

    The sum over all pairs of ``<v_i, v_j> x_i x_j`` is half of ``(sum v x)^2 - sum (v x)^2`` per factor, so a row costs
    as many steps as it has features.
    """
    linear = np.add.reduceat(model["w"][ids] * values, starts)
    scaled = model["v"][ids] * values[:, None]
    total = np.add.reduceat(scaled, starts, axis=0)
    squares = np.add.reduceat(scaled * scaled, starts, axis=0)
    return model["b"] + linear + 0.5 * (total * total - squares).sum(axis=1)


def _laid_out(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(i) for i, _ in rows])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float32), starts


def _filled(row: tuple[np.ndarray, np.ndarray], fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row with its unknown metadata taken as usual ones."""
    ids, values = row
    known = len(values) - len(fill)
    return ids, np.concatenate([values[:known], np.where(np.isnan(values[known:]), fill, values[known:])])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, features: int, rank: int = RANK,
          epochs: int = 12, rate: float = 0.08, batch: int = 64, seed: int = 5) -> dict:
    """Logistic factorisation machine by AdaGrad on mini-batches in a fixed order."""
    rng = np.random.default_rng(seed)
    model = {"b": np.float32(0), "w": np.zeros(features, np.float32), "v": rng.normal(0, 0.02, (features, rank)).astype(np.float32)}
    seen_w, seen_v, seen_b = np.full(features, 1e-3, np.float32), np.full((features, rank), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            ids, values, starts = _laid_out([rows[i] for i in some])
            slope = 1 / (1 + np.exp(-np.clip(raw_scores(ids, values, starts, model), -30, 30))) - labels[some]
            each = np.repeat(slope, np.diff(np.append(starts, len(ids)))).astype(np.float32) * values / len(some)
            scaled = model["v"][ids] * values[:, None]
            total = np.repeat(np.add.reduceat(scaled, starts, axis=0), np.diff(np.append(starts, len(ids))), axis=0)
            used, back = np.unique(ids, return_inverse=True)
            gw = np.bincount(back, each, len(used)).astype(np.float32) + 1e-5 * model["w"][used]
            pair = each[:, None] * (total - scaled)
            gv = np.stack([np.bincount(back, pair[:, f], len(used)) for f in range(rank)], axis=1).astype(np.float32) + 1e-5 * model["v"][used]
            gb = float(slope.mean())
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            seen_b += gb * gb
            model["w"][used] -= rate * gw / np.sqrt(seen_w[used])
            model["v"][used] -= rate * gv / np.sqrt(seen_v[used])
            model["b"] = np.float32(model["b"] - rate * gb / np.sqrt(seen_b))
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id",
        metadata: tuple[str, ...] = ("n_chars",), train_rows: int = TRAIN_ROWS, seed: int = 5) -> dict:
    """A model from a bounded sample of the labelled rows, drawn by a hash of the key; whole texts are used.

    Rows are turned into sparse features where they lie; only those of the sample reach the driver.
    Labels other than 0 and 1 are passed over.  Without a label every score is 0.5.
    """
    def sparse(texts: list, *extra: list) -> list:
        out = []
        for t, *more in zip(texts, *extra):
            ids, values = featurize(t, more)
            out.append((ids.astype(np.int32).tobytes(), values.astype(np.float32).tobytes()))
        return out

    total = max(1, labels.filter(F.col(label).isin(0, 1)).count())
    ones = labels.filter(F.col(label) == 1).count()
    # both labels in the proportion they have
    drawn, _ = labelled_sample(docs, labels, key, label, {1: train_rows * ones // total, 0: train_rows - train_rows * ones // total}, seed)
    got = drawn.select(
        F.col(label).alias("y"),
        per_text("i binary, v binary", sparse, F.col(text), *[F.col(m).cast("double") for m in metadata]).alias("_f"),
    ).select("y", "_f.*").toPandas().sort_values(["y", "i", "v"])
    if not len(got):
        return {"model": None, "metadata": metadata}
    features = [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32)) for i, v in zip(got["i"], got["v"])]
    width = WORD_CELLS + 16 + len(metadata)
    known = np.array([v[len(v) - len(metadata) :] for _, v in features])
    fill = np.where(np.isnan(known), 0, known).sum(axis=0) / np.maximum(1, (~np.isnan(known)).sum(axis=0))
    model = train([_filled(f, fill) for f in features], got["y"].to_numpy(np.float32), width)
    return {"model": model | {"fill": fill}, "metadata": metadata}


def score(text: Column, fitted: dict, metadata: tuple[Column, ...] = ()) -> Column:
    """``struct(score)``: how likely a whole text is of label 1, in 0..1.

    Null and empty texts have no words and are scored by their empty statistics; null metadata count as the mean of the
    training rows.
    """
    model = fitted["model"]
    if model is not None and len(metadata) != len(model["fill"]):
        raise ValueError(f"the model was fitted with metadata {fitted['metadata']}")

    def rate(texts: list, *extra: list) -> list:
        if model is None:
            return [(0.5,)] * len(texts)
        raw = raw_scores(*_laid_out([_filled(featurize(t, more), model["fill"]) for t, *more in zip(texts, *extra)]), model).astype(np.float64)
        return [(float(p),) for p in 1 / (1 + np.exp(-np.clip(raw, -30, 30)))]

    return per_text("score double", rate, text, *[m.cast("double") for m in metadata])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = fit(documents, labels.filter(~held_out))
    scored = score(F.col("text"), model, (F.col("n_chars"),)).score
    return documents.select("doc_id", held_out.alias("held_out"), scored.alias("score")).select(
        "*", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
