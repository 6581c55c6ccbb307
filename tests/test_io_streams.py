import json

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.catalog import load
from cadenza.catalog.views import TABLES
from cadenza.operators import audio as au
from cadenza.operators import inventory as inv
from cadenza.sources import io
from cadenza.streaming import incremental as inc


def test_tolerant_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": {"c": 2}}\n\n   \n{"a": 2\nnot json\n{"a": 3, "extra": 1}\n', encoding="utf-8")
    schema = T.StructType().add("a", "long").add("b", T.StructType().add("c", "long"))
    good, bad = io.read_jsonl_tolerant(spark, str(tmp_path), schema)
    assert sorted((r.a, r.b.c if r.b else None) for r in good.collect()) == [(1, 2), (3, None)]
    assert bad.count() == 2


def test_keyed_arrays_by_file_name(spark, tmp_path):
    for name, body in {"gX_ch01_slice0.json": [{"motion": 0}, {"motion": 1}], "gX_ch01_slice12.json": [{"motion": 5}]}.items():
        (tmp_path / name).write_text(json.dumps(body, indent=2), encoding="utf-8")
    element = T.StructType().add("motion", "long")
    got = sorted(map(tuple, io.read_keyed_arrays(spark, str(tmp_path), element).collect()))
    assert got == [("gX_ch01", 0, 0, 0), ("gX_ch01", 0, 1, 1), ("gX_ch01", 12, 0, 5)]
    (tmp_path / "gX_ch01_slice3.json").write_text('{"motion": 1}', encoding="utf-8")
    with pytest.raises(PySparkException, match="not a JSON array"):
        io.read_keyed_arrays(spark, str(tmp_path), element).collect()


def test_upsert_counts_only_new_keys(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "bvid string, score int")
    new = spark.createDataFrame([("b", 20), ("c", 30)], "bvid string, score int")
    assert sorted(map(tuple, inv.upsert(old, new, "bvid").collect())) == [("a", 1, False), ("b", 20, False), ("c", 30, True)]


def test_stages_resume_from_saved_tables(spark, tmp_path):
    calls = []

    def stage(name, fn):
        def run(done):
            calls.append(name)
            return fn(done)

        return name, run

    stages = [stage("search", lambda d: spark.range(5)), stage("filter", lambda d: d["search"].filter("id > 2"))]
    inv.run_stages(spark, stages, str(tmp_path), "search")
    assert inv.run_stages(spark, stages, str(tmp_path), "filter")["filter"].count() == 2
    assert calls == ["search", "filter", "filter"]


def test_export_drops_internal_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, _b int")
    assert io.export_columns(df).first()[0] == '{"a":1}'


def test_streamed_equals_batch_in_any_file_order(spark, tmp_path):
    rows = [(i % 7, i, f"v{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "k bigint, n bigint, v string")
    for part in (2, 0, 1):  # arrival order differs from row order
        df.filter(F.col("n") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = inc.file_stream(spark, str(tmp_path / "in"), df.schema, 1)
    inc.keyed_upsert(stream, "k", "n", str(tmp_path / "table"), str(tmp_path / "cp"), 4).awaitTermination()
    got = sorted(map(tuple, inc.current_table(spark, str(tmp_path / "table")).select("k", "n", "v").collect()))
    assert got == sorted((k, max(i for i in range(100) if i % 7 == k), f"v{max(i for i in range(100) if i % 7 == k)}") for k in range(7))


@pytest.mark.parametrize("size", [1, 4])
def test_audio_blocks_against_numpy(spark, size):
    rng = np.random.default_rng(3)
    signals = {"loud": rng.normal(size=200) * 0.5, "silent": np.zeros(50), "short": np.ones(3) * 0.2}
    rows = [(k, i, float(v)) for k, s in signals.items() for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "clip string, i bigint, y double")
    snr = {r.clip: r.snr for r in au.snr_proxy(df, "clip", "i", "y", size).collect()}
    present = {r.clip: r.present for r in au.present_ratio(df, "clip", "i", "y", size).collect()}
    for k, y in signals.items():
        rms = [np.sqrt(np.mean(y[i : i + size] ** 2) + 1e-12) for i in range(0, len(y) - size, size)]
        assert present[k] == pytest.approx(np.mean([r > 0.01 for r in rms]) if rms else 0.0)
        if len(rms) < 4:
            assert snr[k] == 0.0
        else:
            r, n = sorted(rms), max(1, len(rms) // 10)
            assert snr[k] == pytest.approx(20 * np.log10(np.mean(r[-n:]) / np.mean(r[:n])))


def test_registry_matches_its_sql_on_the_smallest_tables(spark):
    """A cheap cross-section; tools/check.py compares every query."""
    registry = load()
    texts = registry.sql_texts()
    assert set(texts) <= set(registry.QUERIES)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("duration_summary", "history_upsert", "nearest_beat", "parse_movements", "vector_topk"):
        df = registry.QUERIES[name](spark, SF)
        cur = con.execute(texts[name])
        names = [d[0] for d in cur.description]
        order = sorted(df.columns)
        assert order == sorted(names)
        want = sorted((tuple(r[names.index(c)] for c in order) for r in cur.fetchall()), key=repr)
        assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == want, name
