"""Exact near-duplicate removal by token overlap, without comparing all pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.pairs import BLOCK_ROWS, pairs_in_buckets
from cadenza.sources.scratch import checkpointed


def title_tokens(title: Column) -> Column:
    """Words of letters and digits plus bigrams of adjacent Han characters (a single one stays)."""
    low = F.lower(title)
    words = F.regexp_extract_all(low, F.lit(r"([a-z0-9]+)"), F.lit(1))
    han = F.regexp_extract_all(low, F.lit(r"([\x{4e00}-\x{9fff}]+)"), F.lit(1))
    bigrams = F.flatten(
        F.transform(
            han,
            lambda h: F.when(F.length(h) < 2, F.array(h)).otherwise(
                F.transform(F.sequence(F.lit(1), F.greatest(F.length(h) - 1, F.lit(1))), lambda i: F.substr(h, i, F.lit(2)))
            ),
        )
    )
    return F.array_distinct(F.concat(words, bigrams))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets, 0 for one."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


#: Bits of a set's sketch, and of one with more than ``LARGE`` tokens, whose differences would fill the short one.
BITS, WIDE_BITS, LARGE = 512, 4096, 900
#: Cells of the table of token counts that orders tokens; any order gives the same result.
COUNT_CELLS = 1 << 18


def near_duplicates(records: DataFrame, pos: str, tokens: str, threshold: float = 0.85, block_rows: int = 8 * BLOCK_ROWS) -> DataFrame:
    """``(pos, duplicate)``: true when an earlier record has Jaccard overlap of at least ``threshold``.

    Exact, in four steps:

    1. Equal token sets collapse by hash and compare (first one kept), however many copies there are.
    2. Two sets can only reach the threshold if they share one of their
       ``n - ceil(threshold * n) + 1`` rarest tokens, so only those are dealt out: all others are too few
       to make up the overlap the threshold asks for.  Tokens are known by their hash there, and a set carries a
       sketch: one bit a hash cell, turned over by each token in it.  Sketches differ in no more bits than their
       sets in tokens, so pairs too far apart go without a look at their tokens and none that belongs is lost.
    3. Every set is first compared with one other: of the earliest in the bucket of each of its tokens and
       the one just before it there, the one with the nearest sketch.  A hit settles it, so a large group of near
       copies costs one comparison per member.
    4. Only sets still open are compared with all earlier sets of their buckets whose size and sketch fit.  Buckets are
       worked through in blocks of bounded size, and only pairs with an open set leave a task.
    """
    base = records.select(F.col(pos).alias("_pos"), F.array_sort(F.col(tokens)).alias("_tok"))
    # tokens are cut once; the last step only reads the two short columns of this table
    keyed = checkpointed(base.withColumn("_h", F.sha2(F.array_join("_tok", "\u0001"), 256)))
    sets = checkpointed(
        keyed.groupBy("_h").agg(F.min_by("_tok", "_pos").alias("_tok"), F.min("_pos").alias("_pos")).withColumn("_n", F.size("_tok"))
    )
    prefixes = checkpointed(_prefixes(sets.filter("_n > 0"), threshold))
    cells = prefixes.select("_pos", "_n", "_b", F.explode("_r").alias("_t"))
    # step 3; tokens of one set only meet nobody
    dealt = cells.repartition("_t")
    seen = F.struct("_pos", "_n", "_b")
    firsts = dealt.groupBy("_t").agg(F.min_by(seen, "_pos").alias("_first"), F.count(F.lit(1)).alias("_f")).filter("_f > 1")
    # only a cheap first guess, so a common token may be cut into blocks of positions
    part = Window.partitionBy("_t", "_n", F.floor(F.col("_pos") / 4096)).orderBy("_pos")
    probes = dealt.withColumn("_prev", F.lag(seen).over(part)).join(firsts.hint("shuffle_hash"), "_t").select(
        "_pos", "_n", "_b", F.explode(F.array("_first", "_prev")).alias("_o")
    )
    fits = F.least("_n", "_o._n") >= F.lit(threshold) * F.greatest("_n", "_o._n") - 1e-9
    cheap = probes.filter(F.col("_o").isNotNull() & (F.col("_o._pos") < F.col("_pos")) & fits).select(
        "_pos", F.col("_o._pos").alias("_q"), "_n", F.col("_o._n").alias("_m"), _apart(F.col("_b"), F.col("_o._b")).alias("_apart")
    )
    near = cheap.filter(F.col("_apart") <= F.lit(_reach(threshold)) * (F.col("_n") + F.col("_m")) + 1e-9)
    guesses = checkpointed(near.groupBy("_pos").agg(F.min(F.struct("_apart", "_q")).alias("_best")).select("_pos", "_best._q"))
    settled = checkpointed(_similar(guesses, sets, threshold))
    # step 4
    cells = prefixes.join(settled.withColumn("_settled", F.lit(True)), "_pos", "left").select(
        "_pos", F.log("_n").alias("_size"), F.col("_n").alias("_len"), "_b", F.col("_settled").isNull().alias("_open"), F.explode("_r").alias("_cell")
    )
    reach = _reach(threshold)

    def open_pairs(rows: pd.DataFrame, pairs) -> pd.DataFrame:
        pos, is_open, n = rows["_pos"].to_numpy(), rows["_open"].to_numpy(), rows["_len"].to_numpy()
        short, wide, at = _sketches(rows["_b"])
        kept = [np.zeros((0, 2), np.int64)]
        for a, b in pairs:
            later, earlier = np.where(pos[a] > pos[b], a, b), np.where(pos[a] > pos[b], b, a)
            wanted = is_open[later] & (pos[later] != pos[earlier])
            later, earlier = later[wanted], earlier[wanted]
            most = reach * (n[later] + n[earlier]) + 1e-9
            like = np.bitwise_count(short[later] ^ short[earlier]).sum(axis=1) <= most
            both = np.flatnonzero(like & (at[later] >= 0) & (at[earlier] >= 0))
            if len(both):
                like[both] = np.bitwise_count(wide[at[later[both]]] ^ wide[at[earlier[both]]]).sum(axis=1) <= most[both]
            kept.append(np.column_stack([pos[later[like]], pos[earlier[like]]]))
        return pd.DataFrame(np.unique(np.concatenate(kept), axis=0), columns=["_pos", "_q"])

    # sizes that fit differ by a fixed step of their logarithm
    pairs = pairs_in_buckets(cells, "_cell", "_pos", open_pairs, "_pos long, _q long", "_size", -math.log(threshold) + 1e-9, block_rows)
    rest = _similar(checkpointed(pairs.distinct()), sets, threshold)
    hit = settled.unionByName(rest).distinct().withColumn("_hit", F.lit(True))
    verdict = sets.join(hit, "_pos", "left").select("_h", F.col("_pos").alias("_first_pos"), F.coalesce("_hit", F.lit(False)).alias("_hit"))
    return keyed.join(verdict, "_h").select(
        F.col("_pos").alias(pos), (F.col("_hit") | (F.col("_pos") > F.col("_first_pos"))).alias("duplicate")
    )


def _reach(threshold: float) -> float:
    """Largest symmetric difference of two sets that reach the threshold, as a part of the sum of their sizes."""
    return (1 - threshold) / (1 + threshold)


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``(_pos, _n, _b, _r)``: the sketch of each set and the hashes of its rarest tokens.

    Counts of hash cells of bounded number stand for counts of tokens: they only decide which tokens count as rare.
    """
    hashes = F.transform("_tok", lambda t: F.xxhash64(t))
    counted = sets.select(F.explode(F.transform(hashes, lambda h: h.bitwiseAND(F.lit(COUNT_CELLS - 1)))).alias("_c")).groupBy("_c").count()
    often = np.zeros(COUNT_CELLS, np.int64)
    for cell, count in counted.collect():
        often[cell] = count

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sketches, rare = [], []
            for n, hashed in zip(rows["_n"], rows["_hashes"], strict=True):
                h = np.asarray(hashed, np.int64)
                bits = np.bincount((h >> 20) & ((WIDE_BITS if n > LARGE else BITS) - 1), minlength=WIDE_BITS if n > LARGE else BITS) & 1
                sketches.append(np.packbits(bits.astype(np.uint8)).tobytes())
                first = n - math.ceil(threshold * n - 1e-9) + 1
                rare.append(np.unique(h[np.lexsort((h, often[h & (COUNT_CELLS - 1)]))[:first]]))
            yield pd.DataFrame({"_pos": rows["_pos"], "_n": rows["_n"], "_b": sketches, "_r": rare})

    return sets.select("_pos", "_n", hashes.alias("_hashes")).mapInPandas(judged, "_pos long, _n int, _b binary, _r array<long>")


def _sketches(column: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Short sketches of all rows, the wide ones, and each row's place among these (-1: none)."""
    is_wide = (column.str.len() > BITS // 8).to_numpy()
    read = lambda part, bits: np.frombuffer(b"".join(part), np.uint64).reshape(-1, bits // 64)
    wide = read(column[is_wide], WIDE_BITS)
    short = np.zeros((len(column), BITS // 64), np.uint64)
    short[~is_wide] = read(column[~is_wide], BITS)
    short[is_wide] = np.bitwise_xor.reduce(wide.reshape(-1, WIDE_BITS // BITS, BITS // 64), axis=1)
    return short, wide, np.where(is_wide, np.cumsum(is_wide) - 1, -1)


@F.pandas_udf(T.IntegerType())
def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    """Bits in which two sketches differ, by the wide ones if both are wide."""
    (s, w, i), (t, v, j) = _sketches(a), _sketches(b)
    out = np.bitwise_count(s ^ t).sum(axis=1).astype(np.int32)
    both = np.flatnonzero((i >= 0) & (j >= 0))
    out[both] = np.bitwise_count(w[i[both]] ^ v[j[both]]).sum(axis=1)
    return pd.Series(out)


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    a = sets.select("_pos", F.col("_tok").alias("_a"))
    b = sets.select(F.col("_pos").alias("_q"), F.col("_tok").alias("_b"))
    return pairs.join(a, "_pos").join(b, "_q").filter(jaccard(F.col("_a"), F.col("_b")) >= threshold).select("_pos").distinct()
