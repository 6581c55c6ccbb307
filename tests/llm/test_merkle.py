"""Merkle manifests against a plain recursion."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cadenza.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, k string, hash string, part string, path string"


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(leaves):
    """Root and for each leaf the levels' (left, right)."""
    nodes, ways = [([i], h) for i, h in enumerate(leaves)], [[] for _ in leaves]
    while len(nodes) > 1:
        above = []
        for s in range(0, len(nodes), 3):
            run = nodes[s : s + 3]
            for j, (members, _) in enumerate(run):
                for m in members:
                    ways[m].append(([h for _, h in run[:j]], [h for _, h in run[j + 1 :]]))
            above.append((sum((m for m, _ in run), []), H(h for _, h in run)))
        nodes = above
    return nodes[0][1], ways


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        ranked = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]))
        made[s] = (ranked, *tree([r["leaf"] for r in ranked]))
    root, heads = tree([made[s][1] for s in order])
    out = []
    for s, head in zip(order, heads):
        ranked, subroot, ways = made[s]
        for r, way in zip(ranked, ways):
            path = [*way, *head]
            h = r["changed"]
            for left, right in path:
                h = H([*left, h, *right])
            proof = H("".join(left) + "".join(right) for left, right in path)
            out.append((r["doc_id"], r["leaf"], subroot, root, proof, h, h == root))
    return out


def expected(rows):
    """Brute force over rows in the order of the documents' columns."""
    named = []
    for doc_id, text, lang, source, n_chars, *_ in rows:
        tampered = text
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
            tampered = text.replace("\n", "")
        named.append({"doc_id": doc_id, "source": source, "leaf": leaf_of([doc_id, source, lang, n_chars, text]),
                      "changed": leaf_of([doc_id, source, lang, n_chars, tampered])})
    return brute(named)


def found(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in got.collect()]


def rows_of(sizes, start=0):
    rows, i = [], start
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i * 7 % 100_003, f"line {i}\nnext" if i % 2 else f"one {i}", "en", source, i, "a", "b", "c", "d", "e"))
            i += 1
    return rows


@pytest.mark.parametrize("sizes", [{"only": 1}, {"a": 2}, {"a": 3, "b": 1}, {"a": 4, None: 1, "": 9, "é": 10, "z": 28},
                                   {"hot": 729, "b": 730}, {"hot": 2500, "b": 82, None: 5}])
def test_sizes_of_groups(spark, tmp_path, sizes):
    rows = rows_of(sizes)
    assert sorted(found(spark, rows, tmp_path)) == sorted(expected(rows))


def test_nulls_ties_repeats_and_long_texts(spark, tmp_path):
    more = ("g", None, "h", "p", None)
    rows = [(None, None, None, None, None, *more), (None, "a\nb", "en", None, 3, *more), (1, "", "de", "s", 0, *more), (1, "x\n", "de", "s", 2, *more),
            (1, "x\n", "de", "s", 2, *more), (2, "y\n" * 100_000, None, "s", None, *more), (-5, "ü\n🙂", "", "", -1, *more)]
    rows += [(7, "copy\n", "en", "s", 5, *more)] * 40
    got = found(spark, rows, tmp_path)
    assert sorted(got, key=str) == sorted(expected(rows), key=str)
    assert {r[6] for r in got} == {True, False}


def test_empty_table(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


def test_many_groups_and_ranges(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = rows_of({f"s{i:04d}": 1 + i % 3 for i in range(1000)} | {"m": 900})
        assert sorted(found(spark, rows, tmp_path)) == sorted(expected(rows))
        copies = [(1, "t\n", "en", "s", 1, *"abcde")] * 1600
        assert sorted(found(spark, copies, tmp_path)) == sorted(expected(copies))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fields_cannot_be_moved_between_values(spark):
    pairs = [("a", "1:b"), ("a1:b", None), (None, "a"), ("-", "a"), ("", "a")]
    rows = spark.createDataFrame(pairs, "x string, y string").select(merkle.digest(F.col("x"), F.col("y")).alias("h")).collect()
    assert [r.h for r in rows] == [leaf_of(p) for p in pairs] and len({r.h for r in rows}) == len(pairs)
