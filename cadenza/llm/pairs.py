"""Connected components of links, as Spark jobs and inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.sources.scratch import checkpointed


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions over the links ``a - b``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, component)`` with the smallest id reachable, for ids that are in a link with another one.

    Alternating large and small stars: every round hangs neighbours below the least known id, so chains
    shrink by a constant factor or better and a hub costs one combined minimum.  Rounds end when nothing changes.
    """
    edges = checkpointed(
        links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("u < v").distinct()
    )
    before = None
    while True:
        mark = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if mark[0] == 0 or mark == before:
            return edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("component")).unionByName(
                edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
            )
        before = mark
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(
            F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))
        )).alias("e")).select("e.*").filter("u < v").distinct()
        edges = checkpointed(small)
