"""WARC archives and the corpus pipeline."""

import base64
import hashlib
import os
import tempfile

import corpus_pipeline
from pyspark.sql import functions as F

from cadenza.llm import queries, secrets, simhash, warc

SF = "/root/testdata/sf0.001"
COPY = "<p>copy</p>"
PAGES = [(1, "http://a/1", COPY), (2, "http://a/ü b\r\nX: y", COPY), (3, None, COPY), (3, "again", COPY), (4, "u", None), (5, "u", ""), (None, "n", COPY),
         (7, "u", "🙂" * 5000), (2**60 + 1, "u", "big"), (8, "u", "one"), (8, "u", "two")]


def archived(spark, rows, **how):
    folder = tempfile.mkdtemp(prefix="spark-")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("own"))
    manifest = warc.write_archives(pages, f"file://{folder}/w", **how)
    files = {f: open(f"{folder}/w/{f}", "rb").read() for f in sorted(os.listdir(f"{folder}/w")) if f.endswith(".gz")}
    return manifest.collect(), files, warc.read_archives(spark, f"file://{folder}/w").collect(), os.listdir(f"{folder}/w")


def test_archives_read_back(spark):
    manifest, files, rows, listed = archived(spark, PAGES)
    assert len(rows) == len(PAGES) == sum(m.records for m in manifest) and all(r.digests_hold for r in rows)
    assert "_temporary" not in listed and {m.file: m.file_sha256 for m in manifest} == {f: hashlib.sha256(b).hexdigest() for f, b in files.items()}
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    got = sorted(((r.page_id, r.content_length, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    newest = {}
    for i, _, t in PAGES:
        newest[t or ""] = max(newest.get(t or "", -1), -1 if i is None else i)
    want = [(i, len((t or "").encode()), sha(t), *(("response", None) if i == newest[t or ""] else ("revisit", newest[t or ""]))) for i, _, t in PAGES]
    assert got == sorted(want, key=str)
    assert {r.payload.decode() for r in rows if r.record_type == "response"} == {t or "" for _, _, t in PAGES}


def test_archives_are_deterministic_sorted_and_rolled(spark):
    rows = [(i, f"http://h/{i}", os.urandom(4).hex() * 300 if i % 3 else "same") for i in range(400)]
    first = archived(spark, rows, roll_bytes=3000, shard_bytes=100_000)
    second = archived(spark, rows[::-1], roll_bytes=3000, shard_bytes=100_000)
    assert first[1] == second[1] and len(first[1]) > 4 and len({m.shard for m in first[0]}) > 1
    ids = [r.page_id for r in sorted(first[2], key=lambda r: r.file)]
    assert ids == sorted(ids) == list(range(400))


def test_no_archives_of_an_empty_table_and_small_payloads(spark):
    manifest, files, rows, _ = archived(spark, [])
    assert not manifest and not files and not rows
    assert all(r.record_type == "response" for r in archived(spark, PAGES, least_bytes=1 << 20)[2])


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tempfile.mkdtemp(prefix='spark-')}/out"
        stage(spark, before, SF).write.parquet(out)
        after = spark.read.parquet(out)
        kept[name] = ({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()})
        assert after.count() == len(kept[name][1])
        assert after.columns == columns if name != "sentencepiece" else after.filter("lossless").count() == after.count()
        before = after
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    was, now = kept["quality classifier"]
    assert len(good & set(now)) >= 0.95 * len(good & set(was)) and len(now) < len(was)
    was, now = kept["simhash near-dedup"]
    prints = {i: simhash.fingerprint(t) % (1 << 64) for i, t in was.items()}
    group = {i: i for i in was}
    for a in sorted(was):
        for b in sorted(was):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert set(now) == set(group.values()) and len(now) < len(was)
    was, now = kept["benchmark decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaking = {i for i, t in was.items() if any(x in t for x in items)}
    assert leaking and not leaking & set(now) and len(was) - len(now) == len(leaking)
    was, now = kept["secret scans"]
    spans = secrets.find_spans(spark.createDataFrame(list(was.items()), "doc_id long, text string"), keep=["doc_id"]).collect()
    assert set(was) == set(now) and {i for i in was if was[i] != now[i]} == {r.doc_id for r in spans if r.spans}


def test_pipeline_of_odd_and_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6, "", "en", "s", 0)], docs.schema))
    for rows in (odd.withColumn("score", F.lit(1)), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = spark.createDataFrame(stage(spark, rows, SF).collect(), stage(spark, rows, SF).schema)


def test_unlike_texts_of_one_id_stay(spark):
    a, b, c = (" ".join(f"{x}{i * i % 97}" for i in range(200)) for x in ("fish", "bird", "stone"))
    rows = [(3, b), (5, a), (5, b), (5, c), (5, c), (7, a), (9, c), (None, a)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = [tuple(r) for r in corpus_pipeline.deduplicate(spark, docs, SF).collect()]
        assert sorted(got, key=str) == sorted([(3, b), (5, a), (5, c), (None, a)], key=str)


def test_queries_are_named_by_number():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)
    assert secrets.BASE == ("assign", "access", "hex")
