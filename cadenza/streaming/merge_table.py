"""A keyed table that is merged on reading: a batch writes its own rows only.

Below the base folder lie ``runs`` (parquet, one row a key in each) and ``manifests`` (JSON, the runs that make up a version of
the table).  A version counts from the moment its manifest has its final name, so a batch that fails leaves the version
before it.  Runs are kept in levels: ``fanout`` neighbouring runs of a level are merged into one of the next level, so a row
is written again a logarithmic number of times and a version has few runs.  Runs and manifests that none of the newest
``keep`` versions names are removed.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

_GENERATION = "_generation"


class _Folder:
    """The few operations of the cluster's file system that manifests need."""

    def __init__(self, spark: SparkSession, base: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.base = base
        self._fs = self._path(base).getFileSystem(spark._jsc.hadoopConfiguration())
        self._spark = spark

    def at(self, name: str):
        return self._path(f"{self.base}/{name}")

    def names(self, folder: str) -> list[str]:
        path = self.at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write under a temporary name, then give the final one; a final name that is there already stays."""
        temporary = self.at(f"temporary/{uuid.uuid4().hex}")
        out = self._fs.create(temporary)
        out.write(text.encode("utf-8"))
        out.close()
        self._fs.mkdirs(self.at(name).getParent())
        if self._fs.exists(self.at(name)) or not self._fs.rename(temporary, self.at(name)):
            self._fs.delete(temporary, False)
            raise RuntimeError(f"{name} was written by another job")

    def remove(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self.at(name)).getLength()


def _manifest(folder: _Folder, names: list[str]) -> dict | None:
    return json.loads(folder.read(f"manifests/{names[-1]}")) if names else None


def _newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the highest ``order``, the later batch on ties; a null key is a key, a null order comes first."""
    rest = [c for c in rows.columns if c not in (key, _GENERATION)]
    best = F.max_by(F.struct(*rest), F.struct(order, _GENERATION))
    return rows.groupBy(key).agg(best.alias("_r")).select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def _runs(spark: SparkSession, base: str, manifest: dict, runs: list[dict]) -> DataFrame:
    schema = T.StructType.fromJson(manifest["schema"])
    parts = [spark.read.schema(schema).parquet(f"{base}/runs/{r['name']}").withColumn(_GENERATION, F.lit(r["batch"]).cast("bigint")) for r in runs]
    return reduce(DataFrame.unionByName, parts)


def merge_batch(batch: DataFrame, batch_id: int, base: str, key: str, order: str, fanout: int = 4, keep: int = 2) -> dict:
    """Add a batch as the next version of the table and return its manifest.

    A batch that is part of the table already changes nothing, so a stream may hand it in again after a failure.  Rows
    that repeat a key inside a batch are settled by ``order``, equal ones by all other columns.
    """
    spark, folder = batch.sparkSession, _Folder(batch.sparkSession, base)
    versions = folder.names("manifests")
    known = _manifest(folder, versions)
    if known and known["batch"] >= batch_id:
        return known
    rest = [c for c in batch.columns if c != key]
    own = batch.groupBy(key).agg(F.max(F.struct(F.col(order).alias("_o"), F.struct(*rest).alias("_r"))).alias("_b"))
    own = own.select(key, *[F.col(f"_b._r.`{c}`").alias(c) for c in rest])

    def write(rows: DataFrame, level: int) -> dict:
        name = f"{batch_id:012d}-{level}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{base}/runs/{name}")
        return {"name": name, "level": level, "batch": batch_id}

    manifest = {"batch": batch_id, "key": key, "order": order, "schema": own.schema.jsonValue()}
    runs = (known["runs"] if known else []) + [write(own, 0)]
    while len(tail := [r for r in runs[-fanout:] if r["level"] == runs[-1]["level"]]) == fanout:
        merged = _newest(_runs(spark, base, manifest, tail), key, order)
        runs = runs[:-fanout] + [write(merged.select(own.columns), tail[0]["level"] + 1)]
    manifest["runs"] = runs
    folder.publish(f"manifests/{batch_id:012d}.json", json.dumps(manifest))
    _clean(folder, [*versions, f"{batch_id:012d}.json"], keep)
    return manifest


def _clean(folder: _Folder, versions: list[str], keep: int) -> None:
    """Remove what the newest ``keep`` versions do not name, left-overs of failed batches included."""
    live = {r["name"] for v in versions[-keep:] for r in json.loads(folder.read(f"manifests/{v}"))["runs"]}
    for version in versions[:-keep]:
        folder.remove(f"manifests/{version}")
    for name in folder.names("runs"):
        if name not in live:
            folder.remove(f"runs/{name}")


def merge_stream(source: DataFrame, base: str, key: str, order: str, checkpoint: str, fanout: int = 4, keep: int = 2) -> StreamingQuery:
    """Add every micro-batch of a stream; one stream writes a table."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, base, key, order, fanout, keep)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table(spark: SparkSession, base: str) -> DataFrame | None:
    """The newest version, one row a key; null before the first batch."""
    folder = _Folder(spark, base)
    manifest = _manifest(folder, folder.names("manifests"))
    if manifest is None:
        return None
    return _newest(_runs(spark, base, manifest, manifest["runs"]), manifest["key"], manifest["order"])


def live_bytes(spark: SparkSession, base: str) -> dict[str, int]:
    """Bytes of each run on disk, by name."""
    folder = _Folder(spark, base)
    return {name: folder.size(f"runs/{name}") for name in folder.names("runs")}
