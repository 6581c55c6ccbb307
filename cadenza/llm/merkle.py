"""Merkle dataset manifest: a hash tree per group, a tree over the groups' roots, and a proof for every row.

Rows are numbered within their group, and the digits of that number in base ``FANOUT`` are the row's way through the
tree.  Inside a block of ``FANOUT ** DIGITS`` rows the digit columns are grouped away one after another, each time
nesting the children in their parent, so a block ends as one struct of bounded size; one exchange per block serves all
of its levels.  The blocks' hashes are the nodes of the next tier.  Going back down, the nested structs are exploded and
every child gets its siblings from the array it lies in, so no level is joined to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import id_remainder, table
from cadenza.sources.scratch import checkpointed

FANOUT = 3
#: Levels of a block; it holds ``FANOUT ** DIGITS`` nodes of its lowest level.
DIGITS = 6
BLOCK = FANOUT**DIGITS

_STEP = "struct<left:string,right:string>"


def digest(*values: Column) -> Column:
    """Hex SHA-256 of the values as text, each ``-`` if null, else its UTF-8 length, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _numbered(nodes: DataFrame) -> DataFrame:
    """Add ``rank``: the number of a row in its group ``g`` by (``k``, ``hash``), without bringing a group together.

    Rows lie sorted in ranges and are stored; a row counts from the start of its group in its range.  Only the first
    group of a range may have begun before, so one offset per range completes the numbers.  Equal rows are dealt out by
    their position in the input, so copies of one row may fill many ranges.
    """
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("first", T.BooleanType()),
                           *nodes.schema.fields])
    names = nodes.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, first = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            # runs of equal groups: dictionary codes are compared, null is a group of its own
            codes = pc.dictionary_encode(batch.column("g"), null_encoding="encode").indices
            ends = pc.run_end_encode(codes).run_ends.to_pylist()
            at, lead, start = [], [], 0
            for end in ends:
                group = (batch.column("g")[start].as_py(),)
                if group != last:
                    first = first and last is None
                    last, seen = group, 0
                at.append(pa.array(range(seen, seen + end - start), pa.int64()))
                lead.append(pa.repeat(pa.scalar(first), end - start))
                seen, start = seen + end - start, end
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), pa.concat_arrays(at), pa.concat_arrays(lead), *[batch.column(n) for n in names]],
                ["part", "at", "first", *names])

    order = ["g", "k", "hash"]
    dealt = nodes.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order, "salt").sortWithinPartitions(*order)
    placed = checkpointed(dealt.withColumn("part", F.spark_partition_id()).mapInArrow(count, schema))
    ranges = placed.groupBy("part").agg(
        F.min(F.struct("g")).alias("low"), F.max(F.struct("g")).alias("high"),
        F.max(F.struct(F.struct("g"), "at")).at.alias("last"))
    begun = ranges.select(F.col("high.g").alias("g"), "part", F.lit(1).alias("adds"), (F.col("last") + 1).alias("n")).unionByName(
        ranges.select(F.col("low.g").alias("g"), "part", F.lit(0).alias("adds"), F.lit(0).cast("long").alias("n")))
    before = Window.partitionBy("g").orderBy("part", "adds").rowsBetween(Window.unboundedPreceding, -1)
    carried = begun.withColumn("carry", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("adds = 0").select("part", "carry")
    # one row for each range
    return placed.join(F.broadcast(carried), "part").select(
        *names, (F.col("at") + F.when(F.col("first"), F.col("carry")).otherwise(0)).alias("rank"))


def _rolled(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes (``g``, ``rank``, ``hash``, ``item``) as one nested row each: ``g, block, tall, hash, kids``.

    ``tall`` levels hash their children; a group of few nodes has fewer levels than a block, and the rest passes its only
    node on.  Only block 0 of a group can be such a group's, so its number of nodes tells.
    """
    dealt = nodes.withColumn("block", F.floor(F.col("rank") / BLOCK).cast("long")).repartition("g", "block")
    many = F.count(F.lit(1)).over(Window.partitionBy("g", "block"))
    needed = sum(((many > FANOUT**i).cast("int") for i in range(DIGITS)), F.lit(0))
    digits = {f"d{i}": F.pmod(F.floor(F.col("rank") / FANOUT**i), F.lit(FANOUT)).cast("int") for i in range(DIGITS)}
    level = dealt.select("g", "block", F.when(F.col("block") == 0, needed).otherwise(DIGITS).alias("tall"),
                         *[c.alias(n) for n, c in digits.items()], "hash", F.col("item").alias("kids"))
    for i in range(DIGITS):
        above = [f"d{j}" for j in range(i + 1, DIGITS)]
        child = F.struct(F.col(f"d{i}").alias("at"), "hash", "kids")
        kids = F.array_sort(F.collect_list(child), lambda a, b: a["at"] - b["at"])
        level = level.groupBy("g", "block", "tall", *above).agg(kids.alias("kids"))
        hashed = F.when(F.col("tall") > i, F.sha2(F.array_join("kids.hash", ""), 256)).otherwise(F.col("kids")[0]["hash"])
        level = level.select("g", "block", "tall", *above, hashed.alias("hash"), "kids")
    return level


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Nested blocks of the nodes, of the blocks' hashes, and so on until each group is one block."""
    tiers = []
    while True:
        tiers.append(checkpointed(_rolled(nodes)))
        if not (tiers[-1].agg(F.max("block")).first()[0] or 0):
            return tiers
        nodes = tiers[-1].select("g", F.col("block").alias("rank"), "hash", F.lit(None).cast("boolean").alias("item"))


def _handed_down(blocks: DataFrame, above: DataFrame, given: list[str]) -> DataFrame:
    """The rows of ``blocks`` with the columns ``given`` of the one row of ``above`` for the same (``g``, ``block``)."""
    own = [c for c in blocks.columns if c not in ("g", "block")]
    both = blocks.unionByName(above.select("g", "block", *given), allowMissingColumns=True)
    return both.groupBy("g", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in [*own, *given]])


def _with_siblings(level: int) -> Callable[[Column, Column], Column]:
    hashes = F.col("kids.hash")

    def child(kid: Column, at: Column) -> Column:
        step = F.struct(F.array_join(F.slice(hashes, F.lit(1), at), "").alias("left"),
                        F.array_join(F.slice(hashes, at + 2, F.lit(FANOUT)), "").alias("right"))
        path = F.when(F.col("tall") > level, F.concat(F.array(step), F.col("path"))).otherwise(F.col("path"))
        return F.struct(kid["at"].alias("at"), kid["hash"].alias("hash"), kid["kids"].alias("kids"), path.alias("path"))

    return child


def _emitted(blocks: DataFrame, given: list[str]) -> DataFrame:
    """The lowest nodes of nested blocks, with their way up before the block's: ``g, rank, hash, item, path`` and ``given``."""
    rows = blocks.select("g", "tall", "path", *given, F.col("block").alias("rank"), "kids")
    for i in reversed(range(DIGITS)):
        rows = rows.select("g", "tall", *given, "rank", F.explode(F.transform("kids", _with_siblings(i))).alias("kid")).select(
            "g", "tall", *given, (F.col("rank") * FANOUT + F.col("kid.at")).alias("rank"), "kid.hash", "kid.path", "kid.kids")
    return rows.select("g", *given, "rank", "hash", "path", F.col("kids").alias("item"))


def _down(tiers: list[DataFrame], above: DataFrame, given: list[str]) -> DataFrame:
    """From a path for each group (``g``, ``path``, ``given``) to one for each of its lowest nodes; adds ``top``."""
    top = tiers[-1].select("g", F.col("hash").alias("top"))
    given = [*given, "top"]
    tops = above.unionByName(top, allowMissingColumns=True).groupBy("g").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ["path", *given]])
    rows = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tiers):
        rows = _emitted(_handed_down(blocks.drop("hash"), rows, ["path", *given]), given)
        rows = rows.withColumnRenamed("rank", "block") if blocks is not tiers[0] else rows
    return rows


def manifest(rows: DataFrame, group: Column, key: Column, leaf: Column, *kept: Column) -> DataFrame:
    """``kept`` columns of every row with ``leaf``, ``subroot`` of its group, ``root`` of all and ``path`` from leaf to root.

    Rows of a group ascend by ``key``, nulls first, then by ``leaf``; groups ascend, null first.  ``path`` holds for each
    level that hashes the concatenated digests to the left and right of the row's ancestor.  An empty table gives no row.
    Runs jobs while it is built.
    """
    leaves = rows.select(group.alias("g"), key.alias("k"), leaf.alias("hash"), F.struct(*kept).alias("item"))
    tiers = _tiers(_numbered(leaves).drop("k"))
    nothing = F.lit(None).cast("int")
    subroots = tiers[-1].select(nothing.alias("g"), F.col("g").alias("k"), "hash", F.struct(F.col("g").alias("group")).alias("item"))
    heads = _tiers(_numbered(subroots).drop("k"))
    start = heads[-1].select("g", F.array().cast(f"array<{_STEP}>").alias("path"))
    groups = _down(heads, start, []).select(F.col("item.group").alias("g"), "path", F.col("top").alias("root"))
    return _down(tiers, groups, ["root"]).select("item.*", F.col("hash").alias("leaf"), F.col("top").alias("subroot"), "root", "path")


def siblings(path: Column) -> Column:
    """All digests of a proof, level by level and from left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the stored or tampered row still proves the root.

    Null values have a mark of their own in a leaf; a null source is a group of its own and comes first, null ids come first
    in theirs and are never tampered with; repeated rows have a leaf each.  An empty table gives no row.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.when(id_remainder(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf, changed = digest(*fields, F.col("text")), digest(*fields, text)
    proven = manifest(docs, F.col("source"), F.col("doc_id"), leaf, F.col("doc_id"), F.nullif(changed, leaf).alias("tampered"))
    checked = proven.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return checked.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                          "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same manifest level by level: hashes of runs, siblings joined back, and the fold repeated over the levels.
OP11_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM (SELECT unnest(range(256)) AS b))),
docs AS (
  SELECT row_number() OVER () AS id, d.*, doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295, list_transform(
      string_split(coalesce(doc_id::VARCHAR, '0'), ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 2 = 0 AS even
  FROM (SELECT doc_id, source, lang, n_chars, text FROM documents) d, crc_table),
fields AS (
  SELECT id, doc_id, source, text, even, concat(
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM docs),
leaves AS (
  SELECT id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(u) || ':' || u, '-')) AS changed
  FROM (SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS u FROM fields)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes AS (
  SELECT 0 AS level, source, pos, leaf AS hash, count(*) OVER (PARTITION BY source) AS many FROM ranked
  UNION ALL
  SELECT level + 1, source, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(many) + 2) // 3
  FROM nodes WHERE many > 1 GROUP BY level, source, pos // 3),
subroots AS (
  SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM nodes WHERE many = 1),
heads AS (
  SELECT 0 AS level, place AS pos, subroot AS hash, count(*) OVER () AS many FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(many) + 2) // 3
  FROM heads WHERE many > 1 GROUP BY level, pos // 3),
steps AS (
  SELECT r.id, n.level, string_agg(n.hash, '' ORDER BY n.pos) FILTER (n.pos < r.pos // (3 ** n.level)::BIGINT) AS before,
    string_agg(n.hash, '' ORDER BY n.pos) FILTER (n.pos > r.pos // (3 ** n.level)::BIGINT) AS after
  FROM ranked r JOIN nodes n ON n.source IS NOT DISTINCT FROM r.source AND n.many > 1
    AND n.pos // 3 = r.pos // (3 ** (n.level + 1))::BIGINT GROUP BY r.id, n.level
  UNION ALL
  SELECT r.id, 1000 + h.level, string_agg(h.hash, '' ORDER BY h.pos) FILTER (h.pos < s.place // (3 ** h.level)::BIGINT),
    string_agg(h.hash, '' ORDER BY h.pos) FILTER (h.pos > s.place // (3 ** h.level)::BIGINT)
  FROM ranked r JOIN subroots s ON s.source IS NOT DISTINCT FROM r.source
    JOIN heads h ON h.many > 1 AND h.pos // 3 = s.place // (3 ** (h.level + 1))::BIGINT GROUP BY r.id, h.level),
proofs AS (
  SELECT id, list({'b': coalesce(before, ''), 'a': coalesce(after, '')} ORDER BY level) AS path FROM steps GROUP BY id),
folds AS (
  SELECT id, changed AS hash, path, 0 AS done FROM ranked LEFT JOIN proofs USING (id)
  UNION ALL
  SELECT id, sha256(path[1 + done].b || hash || path[1 + done].a), path, done + 1 FROM folds WHERE done < coalesce(len(path), 0))
SELECT r.doc_id, r.leaf, s.subroot, (SELECT hash FROM heads WHERE many = 1) AS root,
  sha256(coalesce(array_to_string(list_transform(f.path, lambda p: p.b || p.a), ''), '')) AS proof_sha256, f.hash AS folded_root,
  f.hash = (SELECT hash FROM heads WHERE many = 1) AS verified
FROM ranked r JOIN subroots s ON s.source IS NOT DISTINCT FROM r.source
JOIN folds f ON f.id = r.id AND f.done = coalesce(len(f.path), 0)
"""
