"""Near-duplicates of texts and vectors, components, and bucket pairs against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import neardup_vectors, simhash
from cadenza.llm.pairs import components
from cadenza.operators.pairs import pairs_in_buckets
SF = "/root/testdata/sf0.001"


def least_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \n", "One", "One TWO", "ÄÖ x y z", "a b c d a b c d", "w " * 500):
        assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_shingle_hash_is_that_of_spark(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_near_links_are_all_found(spark):
    rng = random.Random(5)
    prints = {0}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            prints.add(base)
            base ^= sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 2, 3, 4))))
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    linked = components(simhash.near_links(nodes, "fp", "node"), "a", "b")
    got = {r.id: r.component for r in linked.collect()}
    ordered = sorted(prints)
    links = [(i, j) for j in range(len(ordered)) for i in range(j) if (ordered[i] ^ ordered[j]).bit_count() <= 2]
    want = least_reachable(range(len(ordered)), links)
    assert links and all(got.get(n, n) == want[n] for n in want)


def test_simhash_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    want = least_reachable(ids, [(a, b) for b in ids for a in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert got == {i: (prints[i], want[i]) for i in ids}


def test_simhash_of_odd_rows(spark):
    rows = [(5, None), (3, ""), (None, " "), (7, "x y z"), (7, "x y z"), (9, "X y\tz"), (None, "only here and nowhere else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("own"))
    got = sorted([(r.doc_id, r.component) for r in simhash.near_duplicates(docs).collect()], key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (7, 7), (7, 7), (9, 7), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(3, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = least_reachable(range(1, 161), links)
    assert all(got[n] == want[n] for n in got) and len(got) == 61 + 59
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("block", [3, 1000])
def test_every_pair_of_a_bucket_meets_once(spark, block):
    cells = spark.createDataFrame([(k, i, float(i % 7)) for i in range(40) for k in ((0,) if i % 4 else (0, 1))] + [(None, 99, 0.0)], "key long, id long, place double")

    def find(rows, pairs):
        ids, key = rows["id"].to_numpy(), rows["key"].to_numpy()
        return pd.DataFrame([(key[a], *sorted((ids[a], ids[b]))) for i, j in pairs for a, b in zip(i, j)], columns=["k", "a", "b"])

    got = sorted(tuple(r) for r in pairs_in_buckets(cells, "key", "id", find, "k long, a long, b long", "place", 2.0, block).collect())
    rows = [tuple(r) for r in cells.filter("key IS NOT NULL").collect()]
    want = sorted((k, *sorted((a, b))) for n, (k, a, p) in enumerate(rows) for l, b, q in rows[:n] if k == l and abs(p - q) <= 2)
    assert got == want


def slow_vectors(rows, least=0.95):
    good = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = np.array(v, float)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b])
             and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= least]
    want = least_reachable([i for i, _ in rows], links)
    return {i: (sum(i in link for link in links), want[i]) for i, _ in rows}


def test_vectors_against_brute_force(spark):
    rng, rows = np.random.default_rng(2), []
    for _ in range(40):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), (base + rng.normal(size=16) * 0.05).tolist()))
    rows += [(len(rows) + i, v) for i, v in enumerate((None, [], [0.0] * 16, [1.0, None], [float("nan")] * 16, [float("inf")] * 16, rows[0][1], rows[0][1],
                                                       [x * 1e-200 for x in rows[0][1]], [1.0] * 8, [1.0] * 4))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("own"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup_vectors.near_duplicates(frame).collect()}
    tiny = len(rows) - 3
    want = slow_vectors([(i, [x * 1e200 for x in v] if i == tiny else v) for i, v in rows])
    assert got == want
    assert neardup_vectors.near_duplicates(frame.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(300):
        a = rng.normal(size=32)
        b = rng.normal(size=32)
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.951 * a + np.sqrt(1 - 0.951**2) * b).tolist())]
    got = neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.filter("n_links > 0").count() >= 0.9 * len(rows)


def test_plan_follows_size_and_threshold():
    small, large = neardup_vectors.plan(1000, 0.95), neardup_vectors.plan(10**8, 0.95)
    assert small[0] < large[0] and small[1] < large[1] and small[2] == large[2] < neardup_vectors.plan(1000, 0.99)[2]


def test_fingerprints_link_through_rows_without_a_key(spark, monkeypatch):
    """0 (id 1), 3 (no id), 15 (id 2): a chain; the same id on unlike texts does not join their groups."""
    prints = {"a": 0, "b": 3, "c": 15, "d": 255 << 20, "e": 255 << 40, "f": 254 << 40}
    monkeypatch.setattr(simhash, "fingerprints", lambda text: F.create_map(*[F.lit(x) for p in prints.items() for x in p])[text])
    rows = [(1, "a"), (None, "b"), (2, "c"), (7, "d"), (7, "e"), (3, "f"), (None, "f")]
    got = [(r.k, r.t, r.component) for r in simhash.near_duplicates(
        spark.createDataFrame(rows, "k long, t string"), text="t", key="k").join(
        spark.createDataFrame([(v, k) for k, v in prints.items()], "fp long, t string"), "fp").collect()]
    assert sorted(got, key=str) == sorted([(1, "a", 1), (None, "b", 1), (2, "c", 1), (7, "d", 7), (7, "e", 3), (3, "f", 3), (None, "f", 3)], key=str)


def test_vectors_link_through_rows_without_a_key_and_with_repeated_keys(spark):
    turn = lambda a: [float(np.cos(a)), float(np.sin(a))]
    chain = [(1, turn(0.0)), (None, turn(0.3)), (2, turn(0.6)), (None, turn(2.0)), (None, turn(2.0))]
    found = lambda rows: sorted(((r.vec_id, r.n_links, r.component_id) for r in neardup_vectors.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert found(chain) == sorted([(1, 1, 1), (None, 2, 1), (2, 1, 1), (None, 1, None), (None, 1, None)], key=str)
    crossed = [(1, turn(0.0)), (1, turn(1.5)), (2, turn(0.1)), (3, turn(1.6))]
    assert found(crossed) == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)], key=str)
