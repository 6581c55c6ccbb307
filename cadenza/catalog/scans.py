"""Readers, writers and inventory joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.catalog import views as vw
from cadenza.catalog.curation import CFG, fused, items
from cadenza.catalog.registry import half_even as he
from cadenza.catalog.registry import query
from cadenza.operators import curation as cur
from cadenza.operators import inventory as inv
from cadenza.plans import curation as plan
from cadenza.sources import io
from cadenza.sources.scratch import checkpointed, scratch_path

S = vw.SHARED

EVENT = T.StructType().add("event_id", "long").add("event_type", "string").add("value", "double")


@query("jsonl_scan_tolerant", """
    SELECT event_type, count(*) AS n, CAST(0 AS BIGINT) AS malformed, round(sum(value), 4) AS total FROM {events} WHERE event_type <> 'error' GROUP BY 1
    UNION ALL SELECT 'malformed', CAST(0 AS BIGINT), count(*), 0.0 FROM {events} WHERE event_type = 'error'""")
def jsonl_scan_tolerant(v):
    e = v.events
    js = F.to_json(F.struct("event_id", "event_type", "value"))
    cut = F.when(F.col("event_type") == "error", F.substring(js, 1, 20)).otherwise(js)
    blank = e.filter("event_type = 'view'").select(F.lit("  ").alias("line"))
    path = scratch_path(v.spark, "jsonl")
    e.select(cut.alias("line")).unionByName(blank).write.text(path)
    good, bad = io.read_jsonl_tolerant(v.spark, path, EVENT)
    counted = good.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("malformed"), F.round(F.sum("value"), 4).alias("total")
    )
    lost = bad.agg(
        F.lit("malformed").alias("event_type"), F.lit(0).cast("bigint").alias("n"),
        F.count(F.lit(1)).alias("malformed"), F.lit(0.0).alias("total"),
    )
    return counted.unionByName(lost)


@query("json_array_scan_keyed", """
    SELECT CAST(base AS VARCHAR) AS base, slice_idx, CAST(motion AS BIGINT) AS motion, start_frame, end_frame FROM {slices}""")
def json_array_scan_keyed(v):
    path = scratch_path(v.spark, "slices")
    rows = v.slices.select(
        F.concat_ws("_slice", F.col("base").cast("string"), F.col("slice_idx").cast("string")).alias("file"),
        F.floor(F.col("motion") / 100000).alias("part"), F.struct("motion", "start_frame", "end_frame").alias("item"),
    )
    # the layout holds one array per file; its length is the number of segments of a 150-frame slice
    rows.groupBy("file", "part").agg(F.to_json(F.array_sort(F.collect_list("item"))).alias("value")).select(
        "file", "value"
    ).write.partitionBy("file").text(path)
    element = T.StructType().add("motion", "long").add("start_frame", "long").add("end_frame", "long")
    return io.read_keyed_arrays(v.spark, path, element).select("base", "slice_idx", "motion", "start_frame", "end_frame")


@query("split_list_scan", "SELECT name AS id, count(*) AS n FROM {seq_names} GROUP BY 1")
def split_list_scan(v):
    path = scratch_path(v.spark, "ids")
    padded = F.when(F.col("item") % 2 == 0, F.concat(F.lit("  "), "name", F.lit(" "))).otherwise(F.col("name"))
    blank = v.seq_names.select(F.lit("   ").alias("line"))
    v.seq_names.select(padded.alias("line")).unionByName(blank).write.text(path)
    return io.read_id_list(v.spark, path).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


S["search_lines"] = """
    SELECT doc_id AS pos, CASE WHEN lang = 'de' THEN '# ' || source WHEN lang = 'es' THEN '  ' ELSE ' ' || lang || ' ' || source || ' ' END AS line
    FROM {documents}"""


@query("keyword_list_scan", """
    SELECT trim(line) AS query, min(pos) AS pos FROM {search_lines} WHERE trim(line) <> '' AND NOT starts_with(line, '#') GROUP BY 1""")
def keyword_list_scan(v):
    from cadenza import config

    words = [w for g in config.GENRE_WORDS.values() for w in g] + list(config.GENERAL_QUERIES)
    builtin = v.spark.createDataFrame(list(enumerate(words)), "pos bigint, line string")
    return inv.keyword_list(builtin, v.search_lines).select("query", "pos")


S["rerun_a"] = """
    SELECT CASE WHEN p_size < 10 THEN '# ' || name ELSE name || CASE WHEN p_size < 20 THEN '.json  # again' ELSE '' END END AS line
    FROM {seq_names} JOIN {part} ON item = p_partkey"""
S["rerun_b"] = "SELECT CASE WHEN p_size > 30 THEN name || '_lost' ELSE ' ' || name || ' ' END AS line FROM {seq_names} JOIN {part} ON item = p_partkey"


@query("worklist_union", """
    WITH names AS (SELECT DISTINCT trim(split_part(line, '#', 1)) AS entry FROM (SELECT * FROM {rerun_a} UNION ALL SELECT * FROM {rerun_b}) WHERE trim(split_part(line, '#', 1)) <> ''),
         known AS (SELECT DISTINCT name || '.json' AS name FROM {seq_names})
    SELECT entry, coalesce(a.name, b.name, '') AS name, CAST(coalesce(a.name, b.name) IS NOT NULL AS BIGINT) AS resolved
    FROM names LEFT JOIN known a ON a.name = entry LEFT JOIN known b ON b.name = entry || '.json'""")
def worklist_union(v):
    inventory = v.seq_names.select(F.concat("name", F.lit(".json")).alias("name"))
    found, lost = inv.worklist([v.rerun_a, v.rerun_b], inventory)
    one = F.lit(1).cast("bigint")
    return found.withColumn("resolved", one).unionByName(
        lost.select("entry", F.lit("").alias("name"), (one - 1).alias("resolved"))
    )


@query("tensor_explode", """
    SELECT vec_id, i // 8 AS frame, (i % 8) // 2 AS joint, i % 2 AS axis, round(CAST(embedding[i + 1] AS DOUBLE), 6) + 0.0 AS value
    FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM {embeddings})""")
def tensor_explode(v):
    row = lambda i: F.slice("embedding", i * 8 + 1, 8)
    nested = v.embeddings.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), row).alias("dance_array"))
    out = io.explode_tensor(nested, "vec_id", "dance_array", 2)
    return out.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("tensor_zip", """
    WITH f AS (SELECT vec_id, embedding, 3 + vec_id % 3 AS m, 2 + vec_id % 5 AS d, unnest(range(7)) AS frame FROM {embeddings}),
         sides AS (SELECT *, frame < m AS heard, frame < d AS seen FROM f WHERE frame < greatest(m, d) AND vec_id % 10 <> 0 AND vec_id % 13 <> 0)
    SELECT vec_id, '' AS reason, frame, CASE WHEN heard THEN round(CAST(embedding[(frame + 437) % 64 + 1] AS DOUBLE), 6) + 0.0 END AS last_feature,
           CASE WHEN heard THEN CAST(embedding[(frame + 53) % 64 + 1] > 0 AS BIGINT) END AS is_beat,
           CASE WHEN seen THEN round(CAST(embedding[frame * 8 + 8] AS DOUBLE), 6) + 0.0 END AS last_value FROM sides
    UNION ALL SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN 'no motion' ELSE 'music frame 1 of width 437' END, NULL, NULL, NULL, NULL
    FROM {embeddings} WHERE vec_id % 10 = 0 OR vec_id % 13 = 0""")
def tensor_zip(v):
    feature = "CASE WHEN j = 53 THEN CAST(embedding[(f + j) % 64] > 0 AS DOUBLE) ELSE CAST(embedding[(f + j) % 64] AS DOUBLE) END"
    width = "CASE WHEN vec_id % 10 = 0 AND f = 1 THEN 437 ELSE 438 END"
    nested = v.embeddings.selectExpr(
        "vec_id", f"transform(sequence(0L, 2 + vec_id % 3), f -> transform(sequence(0, {width} - 1), j -> {feature})) AS music_array",
        "CASE WHEN vec_id % 13 <> 0 THEN transform(sequence(0L, 1 + vec_id % 5), f -> slice(embedding, CAST(f * 8 + 1 AS INT), 8)) END AS dance_array")
    rows, bad = io.zip_tensors(nested, "vec_id")
    last = lambda c: F.round(F.element_at(c, -1).cast("double"), 6) + F.lit(0.0)
    kept = rows.select("vec_id", F.lit("").alias("reason"), "frame", last("music").alias("last_feature"),
                       F.col("is_beat").cast("bigint").alias("is_beat"), last("dance").alias("last_value"))
    return kept.unionByName(bad, allowMissingColumns=True)


@query("partitioned_recommendation_sink", "SELECT rec AS final_recommendation, count(*) AS n, sum(duration_sec) AS seconds FROM {fused} GROUP BY 1")
def partitioned_recommendation_sink(v):
    path = scratch_path(v.spark, "recommendations")
    io.write_recommendations(fused(v).select("bvid", "duration_sec", "final_recommendation"), path)
    back = v.spark.read.parquet(path)
    return back.groupBy("final_recommendation").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_sec").alias("seconds"))


@query("recommendation_sink_unlabelled", """
    SELECT coalesce(rec, 'none') AS rec, count(*) AS n FROM (
        SELECT CASE WHEN duration_sec % 7 = 0 THEN NULL WHEN duration_sec % 11 = 0 THEN 'later' ELSE rec END AS rec FROM {fused}) t
    WHERE rec IS NULL OR rec <> 'drop' GROUP BY 1""")
def recommendation_sink_unlabelled(v):
    path = scratch_path(v.spark, "recommendations")
    label = F.when(F.col("duration_sec") % 7 == 0, None).when(F.col("duration_sec") % 11 == 0, "later").otherwise(F.col("final_recommendation"))
    io.write_recommendations(fused(v).select("bvid", label.alias("final_recommendation")), path, drop=False)
    back = v.spark.read.parquet(path)
    return back.groupBy(F.coalesce("final_recommendation", F.lit("none")).alias("rec")).agg(F.count(F.lit(1)).alias("n"))


S["history"] = """
    SELECT CAST(doc_id AS STRING) AS bvid, CAST(quality + 10 AS DOUBLE) AS score, 'old' AS origin FROM {labels}"""
S["current_run"] = """
    SELECT CAST(doc_id AS STRING) AS bvid, CAST(n_chars AS DOUBLE) AS score, 'new' AS origin FROM {documents}"""


@query("history_upsert", """
    SELECT coalesce(n.bvid, h.bvid) AS bvid, coalesce(n.score, h.score) AS score, coalesce(n.origin, h.origin) AS origin,
           CAST(h.bvid IS NULL AS BIGINT) AS is_new
    FROM {history} h FULL OUTER JOIN {current_run} n ON n.bvid = h.bvid""")
def history_upsert(v):
    return inv.upsert(v.history, v.current_run, "bvid").withColumn("is_new", F.col("is_new").cast("bigint"))


@query("summary_csv_sink", """
    SELECT 'query' AS section, search_query AS name, count(*) AS total, count(*) FILTER (rec = 'keep') AS keep FROM {fused} GROUP BY 2
    UNION ALL SELECT 'genre', genre, count(*), count(*) FILTER (rec = 'keep') FROM (SELECT unnest(genres) AS genre, rec FROM {fused}) GROUP BY 2""")
def summary_csv_sink(v):
    path = scratch_path(v.spark, "summary")
    f = checkpointed(fused(v).select("search_query", "matched_genres", "metadata_filter_pass", "final_recommendation"))
    io.write_summary_csv(cur.query_summary(f), cur.genre_coverage(f), path)
    read = lambda name, schema: v.spark.read.option("header", True).schema(schema).csv(f"{path}/{name}")
    q = read("queries", "name string, total bigint, metadata_passed bigint, keep bigint, review bigint, drop bigint")
    g = read("genres", "name string, total bigint, keep bigint, review bigint")
    return q.select(F.lit("query").alias("section"), "name", "total", "keep").unionByName(
        g.select(F.lit("genre").alias("section"), "name", "total", "keep")
    )


@query("duration_csv_sink", f"""
    SELECT split, count(r.rec) AS n, {he('coalesce(sum(greatest(0.0, duration_sec)), 0.0)', 2)} AS seconds, {he('coalesce(avg(greatest(0.0, duration_sec)), 0.0) / 60.0', 2)} AS minutes_each
    FROM (VALUES ('all'), ('keep'), ('review'), ('drop')) s(split) LEFT JOIN {{fused}} r ON s.split = 'all' OR s.split = r.rec GROUP BY split""")
def duration_csv_sink(v):
    path = scratch_path(v.spark, "summary")
    f = checkpointed(fused(v).select("search_query", "matched_genres", "metadata_filter_pass", "final_recommendation", "duration_sec"))
    io.write_summary_csv(cur.query_summary(f), cur.genre_coverage(f), path, cur.duration_summary(f))
    schema = "split string, n bigint, seconds double, hours double, seconds_each double, minutes_each double"
    return v.spark.read.option("header", True).schema(schema).csv(f"{path}/durations").select("split", "n", "seconds", "minutes_each")


@query("skip_completed", "SELECT doc_id, source FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})")
def skip_completed(v):
    return inv.skip_completed(v.documents.select("doc_id", "source"), v.labels, "doc_id")


@query("stage_resume", "SELECT bvid, CAST(pos AS BIGINT) AS pos, score AS metadata_score FROM {unique_passed}")
def stage_resume(v):
    base = scratch_path(v.spark, "stages")
    stages = [
        ("search", lambda done: items(v)),
        ("filter", lambda done: cur.metadata_gate(done["search"], CFG)),
        ("dedup", lambda done: cur.first_per_key(done["filter"].filter("metadata_filter_pass"), "bvid", "pos")),
    ]
    inv.run_stages(v.spark, stages, base, "search")
    return inv.run_stages(v.spark, stages, base, "dedup")["dedup"].select("bvid", "pos", "metadata_score")


@query("basename_collision_audit", """
    SELECT p_name AS stem, count(DISTINCT p_brand) - 1 AS surplus FROM {part} GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""")
def basename_collision_audit(v):
    return inv.basename_collisions(v.part, "p_name", "p_brand").withColumnRenamed("p_name", "stem")


S["file_inventory"] = "SELECT 'out/' || CAST(o_orderkey AS STRING) AS path, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM {orders} WHERE o_orderstatus <> 'O'"
S["file_records"] = """
    SELECT o_orderkey AS id, 'out/' || CAST(o_orderkey AS STRING) AS target_path,
           CASE WHEN o_orderpriority < '3' THEN 'out/' || CAST(o_custkey AS STRING) END AS recorded_path
    FROM {orders}"""


@query("inventory_reconcile", f"""
    SELECT status, count(*) AS n, {he('sum(size) / 1e9', 6)} AS gb FROM (
        SELECT CASE WHEN t.path IS NOT NULL THEN 'present' WHEN r.path IS NOT NULL THEN 'resumed' ELSE 'to_fetch' END AS status,
               coalesce(t.bytes, r.bytes, 0) AS size
        FROM {{file_records}} LEFT JOIN {{file_inventory}} t ON t.path = target_path LEFT JOIN {{file_inventory}} r ON r.path = recorded_path)
    GROUP BY status""")
def inventory_reconcile(v):
    return inv.reconcile(v.file_records, v.file_inventory, "id", resume=True)


S["media_files"] = """
    SELECT l_orderkey AS id, CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'drop' WHEN 3 THEN 'review' WHEN 4 THEN 'keep' WHEN 5 THEN 'candidates' ELSE 'other' END AS folder,
           CASE l_returnflag WHEN 'A' THEN 'flv' WHEN 'N' THEN 'mp4' ELSE 'avi' END AS ext
    FROM {lineitem}"""


@query("priority_path_lookup", """
    SELECT id, CASE WHEN folder = '' THEN '' ELSE folder || '/' END || CAST(id AS VARCHAR) || '.' || ext AS path FROM {media_files} WHERE folder <> 'other'
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_position(['candidates', 'keep', 'review', 'drop', ''], folder),
                               list_position(['mp4', 'flv', 'webm', 'mkv', 'avi'], ext)) = 1""")
def priority_path_lookup(v):
    return inv.priority_path(v.media_files, "id")


@query("export_wo_internal", """
    SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","stats":{"user_id":' || user_id || ',"props":null}}' AS json FROM {events}""")
def export_wo_internal(v):
    stats = F.struct("user_id", F.lit(None).cast("string").alias("props"))
    internal = v.events.select("event_id", "event_type", stats.alias("stats"), F.col("ts").alias("_local_ts"))
    return io.export_columns(internal)


@query("allow_list_semi", "SELECT item, name FROM {seq_names} WHERE replace(name, '_c01_', '_cAll_') IN (SELECT replace(name, '_c01_', '_cAll_') FROM {seq_names} JOIN {part} ON item = p_partkey WHERE p_type = 'ECONOMY')")
def allow_list_semi(v):
    from cadenza.operators import names

    allowed = v.seq_names.join(v.part.filter("p_type = 'ECONOMY'"), F.col("item") == F.col("p_partkey")).select("name")
    return names.allow_list(v.seq_names.select("item", "name"), allowed, "name")


@query("ignore_list_anti", "SELECT item, name FROM {seq_names} WHERE name NOT IN (SELECT name FROM {seq_names} JOIN {part} ON item = p_partkey WHERE p_type = 'PROMO')")
def ignore_list_anti(v):
    from cadenza.operators import selection

    bad = v.seq_names.join(v.part.filter("p_type = 'PROMO'"), F.col("item") == F.col("p_partkey")).select("name")
    return selection.ignore_list(v.seq_names.select("item", "name"), bad, "name")


@query("split_union", """
    SELECT id, CASE WHEN min(r) = 0 THEN 'train' ELSE 'test' END AS split, count(*) AS lists FROM (
        SELECT DISTINCT doc_id AS id, CASE WHEN quality = 1 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END AS r FROM {labels}) 
    WHERE id IN (SELECT doc_id FROM {documents}) GROUP BY id""")
def split_union(v):
    from cadenza.operators import names

    lab = v.labels
    train = lab.filter("quality = 1").select(F.col("doc_id").alias("id"))
    test = lab.filter("quality = 0 AND toxic = 1").select(F.col("doc_id").alias("id"))
    val = lab.filter("quality = 0 AND toxic = 0").select(F.col("doc_id").alias("id"))
    out = names.split_union(train, [test, val], v.documents.select(F.col("doc_id").alias("id")), "id")
    return out.groupBy("id").agg(F.max("split").alias("split"), F.count(F.lit(1)).alias("lists"))
