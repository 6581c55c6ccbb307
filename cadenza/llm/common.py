"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

Query = Callable[[SparkSession, str], DataFrame]

#: Rows of an Arrow batch at most: texts are long, and the JVM and Python hold whole batches.
BATCH_ROWS = 1000
#: Rows and characters of text a Python task turns into arrays at once; a longer text stands alone.
TEXT_ROWS = 256
TEXT_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fold of a row."""
    return F.crc32(key.cast("string")) % modulus


def hashed_share(*keys: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, label: str, most: dict[int, int], seed: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows of ``docs`` with a 0/1 label, at most about ``most[label]`` of each label, and the numbers of all labels.

    Keys are drawn from the labels by a hash before the texts are looked at, so the side that is broadcast
    holds no more than the wanted rows whatever the size of the tables, and no text is shuffled.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias(label)).distinct()
    sizes = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    share = F.when(F.col(label) == 1, most[1] / max(1, sizes.get(1, 0))).otherwise(most[0] / max(1, sizes.get(0, 0)))
    drawn = known.filter(hashed_share(F.col(key), seed=seed) < share)
    return docs.drop(label).join(F.broadcast(drawn), key), sizes


def per_text(schema: str, fn: Callable[[list], list], text: Column, *more: Column, rows: int = TEXT_ROWS, chars: int = TEXT_CHARS) -> Column:
    """Apply ``fn`` to lists of at most ``rows`` texts (``None`` where null) and pack its tuples into a struct.

    The session's limit of rows in an Arrow batch is lowered to ``BATCH_ROWS`` if it is higher.  A list also ends
    once its texts have ``chars`` characters, so memory is bounded by that and the longest text.

    Further columns reach ``fn`` as further lists.  The texts alone go to Python, so columns of the
    table with any name stay untouched.
    """

    session, limit = SparkSession.active(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(session.conf.get(limit)) <= BATCH_ROWS:
        session.conf.set(limit, str(BATCH_ROWS))

    def run(batches: Iterator) -> Iterator[pd.DataFrame]:
        names = [part.split()[0].strip("`:") for part in _fields(schema)]
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            lists = [c.where(c.notna(), None).tolist() for c in columns]
            found: list = []
            at = 0
            while at < len(lists[0]):
                end, held = at, 0
                while end < len(lists[0]) and end - at < rows and (held < chars):
                    held += 0 if lists[0][end] is None else len(lists[0][end])
                    end += 1
                found += fn(*[v[at:end] for v in lists])
                at = end
            yield pd.DataFrame(found, columns=names)

    if more:
        def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            return run(batches)

        return pandas_udf(many, f"struct<{schema}>")(text, *more)

    def single(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run(batches)

    return pandas_udf(single, f"struct<{schema}>")(text)


def _fields(schema: str) -> list[str]:
    """Top-level parts of ``a int, b array<struct<c int, d int>>``."""
    depth, start, parts = 0, 0, []
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(schema[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, schema[start:]]]
