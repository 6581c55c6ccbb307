"""Embedding vectors: normalising, pooling, cosine context, clustering, retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import sequence as seq

# what is broadcast is cut into parts of about so many bytes
PART_BYTES = 64 * 1024 * 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(vectors: DataFrame, vector: str, eps: float = 1e-8) -> DataFrame:
    sized = vectors.withColumn("_n", norm(F.col(vector)) + eps)
    unit = F.transform(vector, lambda x: x.cast("double") / F.col("_n"))
    return sized.withColumn(vector, unit).drop("_n")


def mean_pool(vectors: DataFrame, group: str, vector: str, eps: float = 1e-8) -> DataFrame:
    """Mean of a group's vectors per dimension, normalised again.

    Averages combine map-side per ``(group, dimension)``, so a large group is never gathered.
    """
    cells = vectors.select(group, F.posexplode(vector).alias("_i", "_v"))
    means = cells.groupBy(group, "_i").agg(F.avg("_v").alias("_m"))
    listed = F.array_sort(F.collect_list(F.struct("_i", "_m")))  # one entry per dimension
    pooled = means.groupBy(group).agg(F.transform(listed, lambda c: c["_m"]).alias(vector))
    return l2_normalize(pooled, vector, eps)


def cosine_context(vectors: DataFrame, key: str, pos: str, vector: str, length: int = 18) -> DataFrame:
    """Per slice of ``length`` vectors: each row's cosine to all rows of its slice plus its relative position.

    A slice has at most ``length`` rows, so it is gathered as one small array.  A shorter last slice has
    cosines of 0 for the rows it lacks; positions run from 0 to 1 in every slice (0 for a single row).
    """
    unit = l2_normalize(vectors.select(key, pos, vector), vector, 0.0)
    grouped = (
        unit.groupBy(key, F.floor(F.col(pos) / length).cast("bigint").alias("slice_idx"))
        .agg(F.array_sort(F.collect_list(F.struct(pos, vector))).alias("_rows"))
    )
    lacking = F.array_repeat(F.lit(0.0), F.lit(length) - F.size("_rows"))
    last = F.greatest(F.size("_rows") - 1, F.lit(1)).cast("double")
    context = F.transform(
        "_rows",
        lambda a, i: F.concat(
            F.transform("_rows", lambda b: dot(a[vector], b[vector])), lacking, F.array(i / last)
        ),
    )
    return grouped.select(key, "slice_idx", F.posexplode(context).alias("step", "context"))


def cluster_frames(context: DataFrame, features: str, k: int = 5, seed: int = 42, starts: int = 3, max_iter: int = 300):
    """One distributed k-means over all rows; returns ``(labelled rows, centroids)``.

    Of several starts the one with the lowest cost is kept; a start ends when its centroids rest.  One model covers
    all slices, so a label means the same in each of them.
    """
    data = context.withColumn("_features", array_to_vector(features)).cache()
    fits = [KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="_features", predictionCol="label").fit(data) for i in range(starts)]
    model = min(fits, key=lambda m: m.summary.trainingCost)
    data.unpersist()
    labelled = model.transform(data).drop("_features").withColumn("label", F.col("label").cast("bigint"))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return labelled, context.sparkSession.createDataFrame(rows, "label bigint, centroid array<double>")


def _sq_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(diff, F.lit(0.0), lambda s, x: s + x)


def assign_nearest(vectors: DataFrame, centroids: DataFrame, key: str, vector: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Label of the nearest centroid (lowest label on ties), one row for each row of ``vectors``.

    The centroids are cut into parts of at most about ``part_bytes``; each part travels as one
    broadcast row and every vector keeps the best over the parts it has met.
    """
    out = vectors.select(key, vector, F.lit(None).cast("struct<d:double,label:bigint>").alias("_b"))
    for part in _parts(centroids, "label", "centroid", part_bytes):
        packed = part.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("_cs"))
        best = F.array_min(F.transform("_cs", lambda c: F.struct(
            _sq_distance(F.col(vector), c["centroid"]).alias("d"), c["label"].cast("bigint").alias("label"))))
        out = out.join(F.broadcast(packed)).withColumn("_b", F.array_min(F.array("_b", best))).drop("_cs")
    return out.select(key, F.col("_b.label").alias("label"), F.col("_b.d").alias("distance_sq"))


def _parts(rows: DataFrame, key: str, vector: str, part_bytes: int) -> list[DataFrame]:
    """``rows`` cut by a hash of the key into parts of about ``part_bytes``."""
    n = max(1, -(-_bytes(rows, vector) // part_bytes))
    return [rows.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def top_k(query: Sequence[float], vectors: DataFrame, key: str, vector: str, k: int, exclude: int | None = None) -> DataFrame:
    """The ``k`` vectors most similar to one query vector; ties by key.  ``exclude`` skips the query itself."""
    pool = vectors if exclude is None else vectors.filter(F.col(key) != exclude)
    q = F.array(*[F.lit(float(x)) for x in query])
    return pool.select(key, dot(F.col(vector), q).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def top_k_per_query(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, skip_self: bool = True,
                    part_bytes: int = PART_BYTES) -> DataFrame:
    """The ``k`` most similar vectors of every query (``query_id, query_vector``): an exact search.

    The queries are cut into parts of at most about ``part_bytes``; each part is broadcast and
    scans the library once.  A query is in one part, so the parts' results are all there is.
    """
    lib = vectors.select(F.col(key).alias("_id"), F.col(vector).alias("_v"))
    found = []
    for part in _parts(queries, "query_id", "query_vector", part_bytes):
        met = lib.join(F.broadcast(part))
        if skip_self:
            met = met.filter(F.col("_id") != F.col("query_id"))
        scored = met.select("query_id", F.col("_id").alias(key), dot(F.col("_v"), F.col("query_vector")).alias("similarity"))
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), key))
        # a rank filter is applied inside every task before the shuffle, so k rows per query and task travel
        found.append(scored.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", key, "similarity"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _bytes(df: DataFrame, vector: str) -> int:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d")).first()
    return int((row["n"] or 0) * ((row["d"] or 0) * 8 + 32))


def positions(vectors: DataFrame, key: str, group: str) -> DataFrame:
    return seq.dense_position(vectors, [group], seq.chunk_index(key), [key], "pos")
