"""Work lists, history and file inventories as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.texts import python_round


def keyword_list(builtin: DataFrame, user_lines: DataFrame | None = None) -> DataFrame:
    """Search queries in first-seen order; a user list replaces the built-in one.

    Both inputs have ``pos, line``.  Lines starting with ``#`` and blank lines are dropped from
    the user list.
    """
    lines = builtin
    if user_lines is not None:
        trimmed = F.trim("line")
        lines = user_lines.filter((trimmed != "") & ~F.startswith("line", F.lit("#"))).select("pos", trimmed.alias("line"))
    return lines.groupBy(F.col("line").alias("query")).agg(F.min("pos").alias("pos"))


def worklist(lists: Sequence[DataFrame], inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of re-run lists (column ``line``) against ``inventory(name)``: resolved and unresolved names."""
    lines = lists[0].select("line")
    for other in lists[1:]:
        lines = lines.unionByName(other.select("line"))
    name = F.trim(F.split_part("line", F.lit("#"), F.lit(1)))
    names = lines.select(name.alias("entry")).filter("entry <> ''").distinct()
    known = inventory.select("name").distinct()
    # an entry matches as written or with the .json suffix
    tried = names.withColumn("name", F.explode(F.array("entry", F.concat("entry", F.lit(".json")))))
    found = tried.join(known, "name").groupBy("entry").agg(F.min(F.struct(F.length("name"), "name")).alias("_m"))
    resolved = found.select("entry", F.col("_m.name").alias("name"))
    return resolved, names.join(resolved, "entry", "left_anti")


def upsert(history: DataFrame, run: DataFrame, key: str) -> DataFrame:
    """New rows replace history rows of the same key; ``is_new`` marks keys absent from history.

    One shuffle: both sides are tagged, and the newest row per key wins by ``max_by``.
    """
    cols = history.columns
    both = history.withColumn("_gen", F.lit(0)).unionByName(run.select(*cols).withColumn("_gen", F.lit(1)))
    rest = F.struct(*[c for c in cols if c != key])
    return (
        both.groupBy(key)
        .agg(F.max_by(rest, "_gen").alias("_row"), F.min("_gen").alias("_oldest"))
        .select(key, "_row.*", (F.col("_oldest") == 1).alias("is_new"))
    )


def skip_completed(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def basename_collisions(paths: DataFrame, stem: str, path: str) -> DataFrame:
    """Stems found under several paths with the number of surplus paths."""
    return (
        paths.select(stem, path).distinct().groupBy(stem)
        .agg((F.count(F.lit(1)) - 1).alias("surplus")).filter("surplus > 0")
    )


def reconcile(records: DataFrame, files: DataFrame, key: str, resume: bool) -> DataFrame:
    """Records per status (present / resumed / to_fetch) with total size in GB.

    ``files(path, bytes)`` lists what exists; ``records`` has ``target_path`` and ``recorded_path``.
    """
    f = files.select("path", "bytes")
    at_target = f.select(F.col("path").alias("target_path"), F.col("bytes").alias("_t"))
    recorded = f.select(F.col("path").alias("recorded_path"), F.col("bytes").alias("_r"))
    joined = records.join(at_target, "target_path", "left").join(recorded, "recorded_path", "left")
    resumed = F.lit(resume) & F.col("_r").isNotNull()
    status = F.when(F.col("_t").isNotNull(), "present").when(resumed, "resumed").otherwise("to_fetch")
    size = F.coalesce("_t", F.when(resumed, F.col("_r")), F.lit(0))
    return joined.groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("n"), python_round(F.sum(size) / 1e9, 6).alias("gb")
    )


# fixed values: search order of folders and file types
FOLDERS = ("candidates", "keep", "review", "drop", "")
EXTENSIONS = ("mp4", "flv", "webm", "mkv", "avi")


def priority_path(files: DataFrame, key: str) -> DataFrame:
    """One path per key: first folder in order, then first file type (``files(key, folder, ext)``)."""
    rank = lambda c, values: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c))
    order = rank("folder", FOLDERS) * 10 + rank("ext", EXTENSIONS)
    folder = F.when(F.col("folder") == "", "").otherwise(F.concat("folder", F.lit("/")))
    path = F.concat(folder, F.col(key).cast("string"), F.lit("."), "ext")
    known = files.filter((rank("folder", FOLDERS) > 0) & (rank("ext", EXTENSIONS) > 0))
    return known.groupBy(key).agg(F.min_by(path, order).alias("path"))


def run_stages(spark, stages, base: str, run_from: str) -> dict[str, DataFrame]:
    """Run ordered ``(name, fn(previous) -> DataFrame)`` stages, each kept as a table under ``base``.

    Stages before ``run_from`` are read back; from there on they are computed again and saved.  An unknown
    name is an error.
    """
    names = [n for n, _ in stages]
    if run_from not in names:
        raise ValueError(f"no stage {run_from!r} among {names}")
    first = names.index(run_from)
    out: dict[str, DataFrame] = {}
    for i, (name, fn) in enumerate(stages):
        path = f"{base}/{name}"
        if i >= first:
            fn(out).write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
    return out


