"""The evaluation job: features of generated sequences in, one row of metrics per experiment and epoch out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import evaluation as ev

#: Feature kinds and the suffix of their metrics.
KINDS = {"kinetic": "k", "geometric": "g"}


def normalized(features: DataFrame, reference: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of one kind, generated and reference, scaled by the reference's mean and deviation."""

    def scaled(rows: DataFrame, keys: list[str]) -> DataFrame:
        long = rows.filter(F.col("kind") == kind).select(*keys, "seq", F.posexplode("vector").alias("dim", "value"))
        done = ev.zscore_by_reference(long, stats, "dim", "value")
        cells = F.array_sort(F.collect_list(F.struct("dim", "value")))  # one cell per dimension
        return done.groupBy(*keys, "seq").agg(F.transform(cells, lambda c: c["value"]).alias("vector"))

    stats = reference.filter(F.col("kind") == kind).select(F.posexplode("vector").alias("dim", "value"))
    return scaled(features, ["experiment", "epoch"]), scaled(reference, [])


def evaluate(features: DataFrame, reference: DataFrame, finished: DataFrame, dims: dict[str, int]) -> DataFrame:
    """The board of ``finished`` (experiment, epoch) pairs with the metrics of all others added.

    ``features`` has ``experiment, epoch, seq, kind, vector``, ``reference`` the same without the first two.  Per
    kind the distance to the reference (``fid``) and the mean distance between generated sequences
    (``div``) are computed for all pairs at once; a pair with a single sequence of a kind stays as a row with its error.
    """
    fresh = features.join(finished.select("experiment", "epoch").distinct(), ["experiment", "epoch"], "left_anti")
    names = fresh.select("experiment", "epoch").distinct().withColumn("_id", F.to_json(F.struct("experiment", "epoch")))
    metrics = None
    for kind, suffix in KINDS.items():
        generated, known = normalized(fresh, reference, kind)
        tagged = generated.withColumn("_id", F.to_json(F.struct("experiment", "epoch")))
        fid = ev.frechet_distance(tagged, known, "_id", "vector", dims[kind]).select("_id", F.lit(f"fid_{suffix}").alias("metric"), F.col("frechet").alias("value"))
        div = ev.mean_pairwise_distance(tagged, "_id", "seq", "vector").select("_id", F.lit(f"div_{suffix}").alias("metric"), F.col("distance").alias("value"))
        both = fid.unionByName(div)
        metrics = both if metrics is None else metrics.unionByName(both)
    wanted = [f"{m}_{s}" for s in KINDS.values() for m in ("fid", "div")]
    every = names.withColumn("metric", F.explode(F.array(*[F.lit(m) for m in wanted])))
    found = every.join(metrics, ["_id", "metric"], "left").withColumn("value", F.col("value").cast("double"))
    lacking = found.groupBy("_id").agg(F.concat_ws(", ", F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("metric"))))).alias("_lacking"))
    error = F.when(F.col("_lacking") != "", F.concat(F.lit("too few sequences for "), "_lacking"))
    computed = found.join(lacking, "_id").select("experiment", "epoch", "metric", "value", error.alias("error"))
    return ev.experiment_board(finished, computed, wanted)
