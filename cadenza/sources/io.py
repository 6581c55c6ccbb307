"""Readers and writers for the file layouts of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad"


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good records and malformed lines; blank lines are neither.

    Lines are parsed with an explicit schema, so nothing is inferred and the job reads the
    files once per consumer.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    parsed = lines.select(F.from_json("value", full, options).alias("r"), "value")
    bad = F.col("r").isNull() | F.col(f"r.{BAD}").isNotNull()
    good = parsed.filter(~bad).select(*[F.col(f"r.{n}").alias(n) for n in schema.names])
    return good, parsed.filter(bad).select(F.col("value").alias("line"))


def read_keyed_arrays(spark: SparkSession, path: str, element: T.StructType) -> DataFrame:
    """Folders of ``<base>_slice<K>.json`` files, one JSON array each: one row per element.

    Base and slice number come from the file (or partition folder) name.  A file that is not
    an array, is cut off or holds a value of another type fails the job; see
    ``read_keyed_arrays_tolerant``.
    """
    judged = _judged_arrays(spark, path, element)
    broken = F.raise_error(F.concat(F.lit("not a JSON array ("), "reason", F.lit("): "), "file"))
    return _elements(judged.withColumn("items", F.when(F.col("reason").isNull(), F.col("items")).otherwise(broken)))


def read_keyed_arrays_tolerant(spark: SparkSession, path: str, element: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The rows of the readable files, and ``(file, reason)`` of all others."""
    judged = _judged_arrays(spark, path, element)
    return _elements(judged.filter("reason IS NULL")), judged.filter("reason IS NOT NULL").select("file", "reason")


def _elements(files: DataFrame) -> DataFrame:
    return files.select("base", "slice_idx", F.posexplode("items").alias("pos", "item")).select("base", "slice_idx", "pos", "item.*")


def _judged_arrays(spark: SparkSession, path: str, element: T.StructType) -> DataFrame:
    raw = (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        .select("value", F.col("_metadata.file_path").alias("_path"))
    )
    name = r"([^/=]+)_slice(\d+)"
    # elements are read as texts first: a null array is a broken file, a null field beside a present text a wrong type
    texts = F.from_json("value", T.ArrayType(T.StructType([T.StructField(f.name, T.StringType()) for f in element])))
    parsed = raw.select(
        F.regexp_extract("_path", name, 1).alias("base"),
        F.regexp_extract("_path", name, 2).cast("bigint").alias("slice_idx"),
        F.col("_path").alias("file"), F.from_json("value", T.ArrayType(element)).alias("items"),
        F.when(F.startswith(F.ltrim("value"), F.lit("[")), texts).alias("texts"),
    )
    wrong = F.exists(
        F.zip_with("items", "texts", lambda i, t: F.when(i.isNull() != t.isNull(), True).otherwise(
            F.exists(F.array(*[i[f.name].isNull() & t[f.name].isNotNull() for f in element]), lambda x: x))),
        lambda x: F.coalesce(x, F.lit(False)),
    )
    reason = F.when(F.col("texts").isNull(), "not a complete array").when(F.col("items").isNull() | wrong, "a value of another type")
    return parsed.withColumn("reason", reason)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids, one per line, trimmed, blanks dropped."""
    ids = spark.read.text(path).select(F.trim("value").alias("id"))
    return ids.filter("id <> ''")


def explode_tensor(nested: DataFrame, key: str, column: str, joint_width: int = 3) -> DataFrame:
    """``array<array<double>>`` per row to ``(key, frame, joint, axis, value)`` rows."""
    frames = nested.select(key, F.posexplode(column).alias("frame", "_values"))
    cells = frames.select(key, "frame", F.posexplode("_values").alias("_i", "value"))
    return cells.select(
        key,
        F.col("frame").cast("bigint").alias("frame"),
        F.floor(F.col("_i") / joint_width).cast("bigint").alias("joint"),
        (F.col("_i") % joint_width).cast("bigint").alias("axis"),
        F.col("value").cast("double").alias("value"),
    )


def zip_tensors(nested: DataFrame, key: str, music: str = "music_array", dance: str = "dance_array", width: int = 438,
                beat: int = 53) -> tuple[DataFrame, DataFrame]:
    """Music and motion of a sequence side by side, and the sequences that can't be laid so.

    One row per frame: ``(key, frame, music, dance, is_beat)``.  The sides may differ in length; the shorter one is null in
    the frames it lacks (``is_beat`` then is, too).  A beat is a music frame whose feature ``beat`` (from 0) is not zero.
    A sequence without one of the sides, or with a music frame that is not ``width`` wide, is rejected as ``(key, reason)``;
    the reason names the first such frame.
    """
    odd = F.filter(F.transform(music, lambda m, i: F.when(~F.size(m).eqNullSafe(width), i)), lambda i: i.isNotNull())
    frame = F.element_at(odd, 1)
    reason = (
        F.when(F.col(music).isNull(), "no music").when(F.col(dance).isNull(), "no motion")
        .when(F.size(odd) > 0, F.concat(F.lit("music frame "), frame.cast("string"), F.lit(" of width "),
                                        F.coalesce(F.size(F.get(F.col(music), frame)), F.lit(0)).cast("string")))
    )
    judged = nested.select(key, music, dance, reason.alias("reason"))
    sides = F.arrays_zip(F.col(music).alias("music"), F.col(dance).alias("dance"))
    frames = judged.filter("reason IS NULL").select(key, F.posexplode(sides).alias("frame", "_s"))
    rows = frames.select(
        key, F.col("frame").cast("bigint").alias("frame"), "_s.music", "_s.dance", (F.get("_s.music", F.lit(beat)) != 0).alias("is_beat"))
    return rows, judged.filter("reason IS NOT NULL").select(key, "reason")


def write_recommendations(records: DataFrame, path: str, keep: bool = True, review: bool = True, drop: bool = True) -> None:
    """All records, laid out by recommendation; each of the three parts can be left out.

    Records without a recommendation or with another one are always written, to partitions of their own; the whole folder
    reads back as all records.
    """
    left_out = [n for n, on in (("keep", keep), ("review", review), ("drop", drop)) if not on]
    wanted = ~F.coalesce(F.col("final_recommendation").isin(*left_out), F.lit(False)) if left_out else F.lit(True)
    # one partition value may hold most rows: write from the partitions the plan already has
    records.filter(wanted).write.mode("overwrite").partitionBy("final_recommendation").parquet(path)


def write_summary_csv(query_table: DataFrame, genre_table: DataFrame, path: str, duration_table: DataFrame | None = None) -> None:
    """CSV outputs with headers, per search query, per genre and, if given, of durations.

    Every file begins with a byte order mark, by which spreadsheets know UTF-8.
    """
    for name, table in (("queries", query_table), ("genres", genre_table), ("durations", duration_table)):
        if table is not None:
            marked = table.withColumnRenamed(table.columns[0], "\ufeff" + table.columns[0])
            marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(f"{path}/{name}")


def export_columns(records: DataFrame) -> DataFrame:
    """Drop internal columns (leading underscore) and serialise each record as JSON."""
    public = [c for c in records.columns if not c.startswith("_")]
    return records.select(F.to_json(F.struct(*public), {"ignoreNullFields": "false"}).alias("json"))
