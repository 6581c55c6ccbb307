"""Structured Streaming queries, run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.catalog.curation import CFG, items
from cadenza.catalog.registry import query
from cadenza.operators import curation as cur
from cadenza.sources.scratch import scratch_path
from cadenza.streaming import incremental as inc
from cadenza.streaming import merge_table


def staged(v, df, batches=4):
    """The given rows as several files, to be read as a stream of a few batches.

    Files grow in number with the input, not in size: at least one for every part Spark reads it in.
    """
    path = scratch_path(v.spark, "incoming")
    each = -(-df.rdd.getNumPartitions() // batches)
    df.repartition(each * batches).write.parquet(path)
    return inc.file_stream(v.spark, path, df.schema, each)


@query("stream_ingest_filter", "SELECT pos, CAST(pass AS BIGINT) AS pass, score AS metadata_score FROM {judged} WHERE pass")
def stream_ingest_filter(v):
    out, state = scratch_path(v.spark, "ingested"), scratch_path(v.spark, "state")
    stream = staged(v, items(v))
    gate = lambda df: cur.metadata_gate(df, CFG).filter("metadata_filter_pass").select(
        "pos", F.col("metadata_filter_pass").cast("bigint").alias("pass"), "metadata_score")
    inc.ingest(stream, gate, out, state).awaitTermination()
    return v.spark.read.schema("pos bigint, pass bigint, metadata_score double").parquet(out)


@query("stream_dedup", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM {events}) GROUP BY 1")
def stream_dedup(v):
    out, state = scratch_path(v.spark, "unique"), scratch_path(v.spark, "state")
    events = v.events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    stream = staged(v, events)
    # the delay spans the input, so that a key is unique over all of it
    inc.dedup(stream, "user_id", "ts", "60 days", out, state).awaitTermination()
    return v.spark.read.schema(events.schema).parquet(out).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_upsert", """
    SELECT user_id, event_id, event_type, value FROM {events} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def stream_upsert(v):
    base, state = scratch_path(v.spark, "table"), scratch_path(v.spark, "state")
    rows = v.events.select("user_id", "event_id", "event_type", "value")
    # files in event order, as an incoming feed would be
    path = scratch_path(v.spark, "incoming")
    rows.repartitionByRange(3, "event_id").write.parquet(path)
    stream = inc.file_stream(v.spark, path, rows.schema, 1)
    inc.keyed_upsert(stream, "user_id", "event_id", base, state, 8).awaitTermination()
    return inc.current_table(v.spark, base).select("user_id", "event_id", "event_type", "value")


@query("stream_merge_table", """
    SELECT user_id, event_id, event_type, value FROM {events} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def stream_merge_table(v):
    base, state = scratch_path(v.spark, "table"), scratch_path(v.spark, "state")
    stream = staged(v, v.events.select("user_id", "event_id", "event_type", "value"), 6)
    merge_table.merge_stream(stream, base, "user_id", "event_id", state, fanout=3).awaitTermination()
    return merge_table.read_table(v.spark, base)
