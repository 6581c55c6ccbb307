"""From raw documents to sampled token ids: five stages, each a function of the rows the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontamination, pieces, quality, secrets, simhash
from cadenza.llm.common import id_remainder, table
from cadenza.sources.scratch import checkpointed

#: Documents scored lower are rejected.
LEAST_QUALITY = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents the quality classifier accepts; labels of one fold in five are never learnt from."""
    labels = table(spark, sf_dir, "labels").filter(id_remainder(F.col("doc_id"), 5) != 0)
    metadata = tuple(c for c in ("n_chars",) if c in docs.columns)
    model = quality.fit(docs, labels, metadata=metadata)
    return docs.filter(quality.score(F.col("text"), model, tuple(F.col(c) for c in metadata)).score >= LEAST_QUALITY)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies; documents without an id stay.

    Groups are of texts, so rows that share an id with unlike texts stay in different groups; of several rows with the
    smallest id of a group the one with the smallest hash of all its columns stays, and of equal rows one.
    """
    mark = "_row"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    # 128 bits of all columns; nulls have a place of their own
    parts = [*[F.col(c) for c in docs.columns], *[F.col(c).isNull() for c in docs.columns]]
    halves = [f"{mark}a", f"{mark}b"]
    rows = docs.filter(F.col("doc_id").isNotNull()).withColumns({h: F.xxhash64(F.lit(i), *parts) for i, h in enumerate(halves)})
    groups = simhash.near_duplicates(rows.withColumn(mark, F.struct("doc_id", *halves)), key=mark)
    first = groups.select(*[F.col("component")[h].alias(h) for h in halves]).distinct()
    kept = rows.join(first, halves, "left_semi").dropDuplicates(halves).drop(*halves)
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return docs.filter(F.size(decontamination.leaks(F.col("text"), table(spark, sf_dir, "benchmark"))) == 0)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets and linked credentials; the length follows the text."""
    return secrets.redact(docs, length="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ``ids``, the sampled piece ids, and ``lossless``, whether decoding them gives back the text.

    Columns of these names that the documents have are replaced.
    """
    coded = docs.select(*[F.col(c) for c in docs.columns if c not in ("ids", "lossless")],
                        pieces.encode_checked(F.col("text"), F.col("doc_id"), pieces.load()).alias("_coded"))
    return coded.select(*coded.columns[:-1], "_coded.*")


STAGES = [
    ("quality classifier", classify),
    ("simhash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact),
    ("sentencepiece", encode),
]

#: Trained models, SimHash and sampled segmentations have no SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass all stages, with secrets masked, piece ids and the round trip's outcome.

    Null texts count as empty for the classifier and have neither passages nor secrets nor pieces; null ids are never near
    copies; an empty table gives no row.  Each stage's result is stored before the next one starts.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
