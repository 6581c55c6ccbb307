"""SimHash near-duplicates, found over a table of distances to reference fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import per_text, table
from cadenza.llm.pairs import components, local_roots
from cadenza.operators.pairs import pairs_in_buckets
from cadenza.sources.scratch import checkpointed

SEED = 42
WORDS = 3
MOST_BITS = 2
FAMILIES = 4
REFERENCES = 8


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text as a signed number; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - WORDS + 1)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(WORDS, len(words)) - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int32) * 2 > n
    return int(np.packbits(ones, bitorder="little").view(np.int64)[0])


def fingerprints(text: Column) -> Column:
    """Signed fingerprint of whole texts; null, empty and blank texts give 0."""
    return per_text("fp long", lambda texts: [(fingerprint(t),) for t in texts], text).fp


def references(families: int = FAMILIES, each: int = REFERENCES, seed: int = SEED) -> list[list[int]]:
    """Families of reference fingerprints.

    The members of a family differ only inside one block of the 64 bits, so how the distances to them
    differ from one another depends on that block of a fingerprint alone.
    """
    rng = np.random.default_rng(seed)
    size = 64 // families
    base, out = int(rng.integers(1 << 63)), []
    for f in range(families):
        masks = [0, *(int(rng.integers(1, 1 << size)) << (f * size) for _ in range(each - 1))]
        out.append([((base ^ m) + (1 << 63)) % (1 << 64) - (1 << 63) for m in masks])
    return out


def near_links(nodes: DataFrame, fp: str, node: str, most_bits: int = MOST_BITS) -> DataFrame:
    """Links ``(a, b)`` that join all fingerprints at most ``most_bits`` apart into the same components.

    ``nodes`` has one row per distinct fingerprint.  Its distances to the references are computed once.  As
    ``most_bits`` bits lie in that many blocks at most, two near fingerprints have the same distance
    pattern for all but ``most_bits`` families: they meet in a bucket of such a choice of families.  In
    the bucket, pairs with a distance to any reference that differs by more than ``most_bits`` are discarded
    (triangle inequality), survivors are verified on the bits.  Buckets return a star for each group of linked
    fingerprints, not all its pairs.
    """
    families = references()
    kept = len(families) - most_bits
    if kept < 1:
        raise ValueError("more differing bits than families of references")
    distance = lambda p: F.bit_count(F.col(fp).bitwiseXOR(F.lit(p))).cast("tinyint")
    tabled = nodes.select(
        F.col(node).alias("id"), F.col(fp).alias("fp"), *[F.array(*[distance(p) for p in fam]).alias(f"d{i}") for i, fam in enumerate(families)]
    )
    pattern = lambda i: F.transform(F.col(f"d{i}"), lambda d: d - F.element_at(F.col(f"d{i}"), 1))
    choices = list(combinations(range(len(families)), kept))
    cells = tabled.select(
        "id", "fp", F.concat(*[f"d{i}" for i in range(len(families))]).alias("table"),
        F.explode(F.array(*[F.xxhash64(F.lit(c), *[pattern(i) for i in choice]) for c, choice in enumerate(choices)])).alias("cell"),
    )

    def find(rows: pd.DataFrame, pairs) -> pd.DataFrame:
        dist = np.vstack(rows["table"].to_numpy()).astype(np.int8)
        bits, ids = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["id"].to_numpy(np.int64)
        a, b = [], []
        for i, j in pairs:
            keep = np.abs(dist[i] - dist[j]).max(axis=1) <= most_bits
            i, j = i[keep], j[keep]
            keep = np.bitwise_count(bits[i] ^ bits[j]) <= most_bits
            a.append(i[keep])
            b.append(j[keep])
        root = local_roots(len(rows), np.concatenate([*a, []]).astype(int), np.concatenate([*b, []]).astype(int))
        out = root != np.arange(len(rows))
        return pd.DataFrame({"a": ids[out], "b": ids[root[out]]})

    return pairs_in_buckets(cells, "cell", "id", find, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", most_bits: int = MOST_BITS) -> DataFrame:
    """``(key, fp, component)`` for every row: its fingerprint and the smallest key reachable over near links.

    Equal fingerprints, so exact copies and all texts without a word, are one node however many rows
    have them.  Rows that repeat a key stay; a null key keeps its row and counts as no key: a component of such
    rows alone is null.
    """
    marked = checkpointed(docs.select(F.col(key).alias("key"), fingerprints(F.col(text)).alias("fp")))
    # fingerprints link by themselves, whatever keys their rows have; keys only name the finished components
    nodes = marked.groupBy("fp").agg(F.min("key").alias("least"))
    linked = components(near_links(nodes, "fp", "fp", most_bits), "a", "b")
    rooted = nodes.join(linked, F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return marked.join(rooted.join(named, "root").select("fp", "component"), "fp").select(F.col("key").alias(key), "fp", "component")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
