"""Embedding near-duplicates by counting collisions of one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import table
from cadenza.llm.pairs import components
from cadenza.operators.pairs import pairs_in_buckets
from cadenza.sources.scratch import checkpointed

#: Projections whose collisions are counted for a pair.
PROJECTIONS = 64
#: Half width of the window around a query in every projection.
WINDOW = 0.6
#: Share of pairs at the threshold that must pass the collision count, and that must meet in a bucket.
COUNT_RECALL = 0.999
MEET_RECALL = 0.98
#: Width of a bucket's side, and unlike vectors a vector may meet by chance in one bucket.
CELL = 2.0
CHANCE = 4.0


def _same_cell(distance: float, width: float = CELL) -> float:
    """Chance that two points at a distance share a cell of a random line's grid."""
    r = width / distance
    inside = math.erf(r / math.sqrt(2))
    return inside - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, least: float) -> tuple[int, int, int]:
    """Lines per bucket, bucket tables, and the least collision count, from the number of rows and the threshold.

    The lines grow with the logarithm of the rows, so a bucket holds the same number of unlike vectors at any
    size; the tables follow from the wanted recall of a pair exactly at the threshold, and so does the count:
    it is the binomial quantile of collisions of such a pair.
    """
    distance = math.sqrt(max(1e-6, 2 - 2 * least))
    near, far = _same_cell(distance), _same_cell(math.sqrt(2))
    lines = max(1, math.ceil(math.log(max(1.0, rows / CHANCE)) / -math.log(far)))
    # the last line of a bucket is a window around the query instead of a cell
    meet = near ** (lines - 1) * math.erf(WINDOW / distance / math.sqrt(2)) if lines > 1 else math.erf(WINDOW / distance / math.sqrt(2))
    tables = max(1, math.ceil(math.log(1 - MEET_RECALL) / math.log(1 - min(meet, 0.999999))))
    p, below, count = math.erf(WINDOW / distance / math.sqrt(2)), 0.0, 0
    while count < PROJECTIONS:
        below += math.comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        if below > 1 - COUNT_RECALL:
            break
        count += 1
    return lines, tables, count


def _directions(dims: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).normal(size=(dims, count))


def near_pairs(vectors: DataFrame, rows: int, least: float = 0.95, seed: int = 11) -> DataFrame:
    """``(a, b)`` with ``a < b`` of distinct vectors with cosine ``least`` or more, found by collisions.

    ``vectors`` has ``id``, ``v`` (array of doubles, finite, not zero) with one row per distinct vector.  Unit
    vectors are projected on random lines.  Tables of buckets bring together what shares the cells of
    some lines and lies, in the order of one more line, within the window around it.  Pairs that meet are
    counted over all counting lines; those with enough collisions are verified by their exact cosine.
    """
    lines, tables, count = plan(rows, least)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            groups: dict[int, list[int]] = {}
            for at, v in enumerate(batch["v"]):
                groups.setdefault(len(v), []).append(at)
            for dims, at in sorted(groups.items()):
                x = np.vstack(batch["v"].iloc[at].to_numpy()).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                counted = np.clip(np.rint(x @ _directions(dims, PROJECTIONS, seed) * 32), -127, 127).astype(np.int8)
                grid = x @ _directions(dims, tables * lines, seed + 1)
                shift = np.random.default_rng([seed, 2]).uniform(0, CELL, tables * lines)
                cells = np.floor((grid + shift) / CELL).astype(np.int64).reshape(len(at), tables, lines)
                cells[:, :, -1] = dims
                place = grid.reshape(len(at), tables, lines)[:, :, -1]
                for i, row in enumerate(at):
                    out.append((batch["id"].iloc[row], counted[i].tobytes(), cells[i].tolist(), place[i].tolist()))
            yield pd.DataFrame(out, columns=["id", "c", "cells", "place"])

    projected = vectors.select("id", "v").mapInPandas(project, "id long, c binary, cells array<array<long>>, place array<double>")
    cells = projected.select("id", "c", F.posexplode(F.arrays_zip("cells", "place")).alias("t", "x")).select(
        "id", "c", F.xxhash64("t", "x.cells").alias("cell"), F.col("x.place").alias("place"))
    reach = WINDOW * 32

    def find(found: pd.DataFrame, pairs) -> pd.DataFrame:
        ids, c = found["id"].to_numpy(np.int64), np.vstack([np.frombuffer(b, np.int8) for b in found["c"]]).astype(np.int16)
        kept = [np.zeros((0, 2), np.int64)]
        for i, j in pairs:
            for at in range(0, len(i), 20_000):
                a, b = i[at : at + 20_000], j[at : at + 20_000]
                enough = (np.abs(c[a] - c[b]) <= reach).sum(axis=1) >= count
                kept.append(np.column_stack([ids[a[enough]], ids[b[enough]]]))
        both = np.sort(np.concatenate(kept), axis=1)
        return pd.DataFrame(np.unique(both, axis=0), columns=["a", "b"])

    met = pairs_in_buckets(cells, "cell", "id", find, "a long, b long", order="place", near=WINDOW).filter("a < b").distinct()
    left = vectors.select(F.col("id").alias("a"), F.col("v").alias("va"))
    right = vectors.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    cosine = product(F.col("va"), F.col("vb")) / (F.sqrt(product(F.col("va"), F.col("va"))) * F.sqrt(product(F.col("vb"), F.col("vb"))))
    return met.join(left, "a").join(right, "b").filter(cosine >= least).select("a", "b")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """``(key, n_links, component_id)`` for every row.

    Equal vectors form one class that takes part once and counts with all its rows.  Vectors that are null,
    empty or zero or hold a null or a non-finite number link with nothing, as do vectors of different
    lengths.  A row with a null key keeps its row and is no smallest key.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    scale = F.array_max(F.transform(v, F.abs))
    scaled = F.transform(v, lambda x: x / scale)  # so that squares neither overflow nor vanish
    rows = vectors.select(F.col(key).alias("key"), F.when(usable, scaled).alias("v"), F.when(usable, v).alias("raw"))
    # a class is known by 128 bits of its vector and its length
    rows = rows.withColumn("class", F.when(F.col("raw").isNotNull(), F.concat_ws(
        "-", F.size("raw"), F.xxhash64("raw"), F.xxhash64(F.lit(1), F.reverse("raw")))))
    # classes link by numbers of their own, whatever keys their rows have; keys only name the finished components
    classes = checkpointed(rows.filter("class IS NOT NULL").groupBy("class").agg(
        F.min("key").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")).withColumn("id", F.monotonically_increasing_id()))
    pairs = checkpointed(near_pairs(classes.select("id", "v"), classes.count(), least))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(classes.select(F.col("id").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("links"))
    rooted = classes.select("class", "id", "n", "least").join(links, F.col("id") == F.col("a"), "left").drop("a").join(
        components(pairs, "a", "b").withColumnRenamed("id", "c"), F.col("id") == F.col("c"), "left"
    ).select("class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("root"), "least")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = rooted.join(smallest, "root").select("class", "n_links", "component_id")
    # rows outside every class get keys of their own, so that they do not meet in one task
    keyed = rows.select("key", F.coalesce("class", F.concat(F.lit("none "), F.xxhash64("key"))).alias("class"))
    return keyed.join(placed, "class", "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "key").alias("component_id"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).select("*", (F.col("vec_id") == F.col("component_id")).alias("kept"))


OP6_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links,
       (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) AS kept
FROM embeddings e
"""
