"""Embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.catalog import views as vw
from cadenza.catalog.registry import half_up as hu
from cadenza.catalog.registry import query, rounded
from cadenza.operators.clusters import cluster_each
from cadenza.operators import cells as ce
from cadenza.operators import vectors as ve

D = vw.DUCK


def cells(df, *keys, vector="embedding", digits=6):
    out = df.select(*keys, F.posexplode(vector).alias("dim", "value"))
    return rounded(out, "value", digits=digits)


D["vec_cells"] = "SELECT vec_id, seq, pos, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, seq, pos, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM {vectors})"


@query("l2_normalize", f"""
    SELECT vec_id, dim, {hu('value / (sqrt(sum(value * value) OVER (PARTITION BY vec_id)) + 1e-8)')} AS value FROM {{vec_cells}}""")
def l2_normalize(v):
    return cells(ve.l2_normalize(v.embeddings.select("vec_id", "embedding"), "embedding"), "vec_id")


D["pooled"] = "SELECT seq, dim, m / (sqrt(sum(m * m) OVER (PARTITION BY seq)) + 1e-8) AS value FROM (SELECT seq, dim, avg(value) AS m FROM {vec_cells} GROUP BY ALL)"


@query("mean_pool", f"SELECT seq, dim, {hu('value')} AS value FROM {{pooled}}")
def mean_pool(v):
    return cells(ve.mean_pool(v.vectors, "seq", "embedding"), "seq")


D["context"] = """
    WITH u AS (SELECT seq, pos, embedding, pos // 18 AS slice_idx, pos % 18 AS step, count(*) OVER (PARTITION BY seq, pos // 18) AS n FROM {vectors})
    SELECT a.seq, a.slice_idx, a.step, b.step AS dim, CAST(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS DOUBLE)
           / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS value
    FROM u a JOIN u b ON a.seq = b.seq AND a.slice_idx = b.slice_idx
    UNION ALL SELECT seq, slice_idx, step, d, 0.0 FROM u, range(0, 18) t(d) WHERE d >= n
    UNION ALL SELECT seq, slice_idx, step, 18, step / greatest(n - 1, 1)::DOUBLE FROM u"""


@query("cosine_context", f"SELECT seq, slice_idx, step, dim, {hu('value')} AS value FROM {{context}}")
def cosine_context(v):
    return cells(ve.cosine_context(v.vectors, "seq", "pos", "embedding"), "seq", "slice_idx", "step", vector="context")


@query("cluster_frames")
def cluster_frames(v):
    context = ve.cosine_context(v.vectors, "seq", "pos", "embedding")
    return cluster_each(context, "seq", ["slice_idx", "step"], "context")


@query("assign_nearest_centroid", f"""
    WITH d AS (SELECT vec_id, p.seq AS label, sum(power(c.value - p.value, 2)) AS d FROM {{vec_cells}} c JOIN {{pooled}} p ON p.dim = c.dim GROUP BY ALL)
    SELECT vec_id, arg_min(label, {{'d': d, 'l': label}}) AS label, {hu('min(d)')} AS distance_sq FROM d GROUP BY vec_id""".replace("{'d'", "{'d'"))
def assign_nearest_centroid(v):
    centroids = ve.mean_pool(v.vectors, "seq", "embedding").select(F.col("seq").alias("label"), F.col("embedding").alias("centroid"))
    out = ve.assign_nearest(v.embeddings.select("vec_id", "embedding"), centroids, "vec_id", "embedding")
    return rounded(out, "distance_sq")


def queries_of(v):
    pooled = ve.mean_pool(v.vectors, "seq", "embedding")
    return pooled.select(F.col("seq").alias("query_id"), F.col("embedding").alias("query_vector"))


@query("vector_topk", f"""
    WITH s AS (SELECT p.seq AS query_id, vec_id, sum(p.value * c.value) AS s FROM {{vec_cells}} c JOIN {{pooled}} p ON p.dim = c.dim GROUP BY ALL)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, vec_id, {hu('s')} AS similarity FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10""")
def vector_topk(v):
    lib = v.embeddings.select("vec_id", "embedding")
    return rounded(ve.top_k_per_query(queries_of(v), lib, "vec_id", "embedding", 10, skip_self=False), "similarity")


@query("exclude_self_match", f"""
    WITH q AS (SELECT embedding FROM {{embeddings}} WHERE vec_id = 0)
    SELECT vec_id, {hu('list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])')} AS similarity FROM {{embeddings}} e, q WHERE vec_id <> 0
    ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vec_id LIMIT 5""")
def exclude_self_match(v):
    lib = v.embeddings.select("vec_id", "embedding")
    query_vector = lib.filter("vec_id = 0").first()["embedding"]
    return rounded(ve.top_k(query_vector, lib, "vec_id", "embedding", 5, exclude=0), "similarity")


@query("vector_topk_cells", f"""
    WITH s AS (SELECT p.seq AS query_id, vec_id, sum(p.value * c.value) AS s FROM {{vec_cells}} c JOIN {{pooled}} p ON p.dim = c.dim GROUP BY ALL)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, vec_id, {hu('s')} AS similarity FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10""")
def vector_topk_cells(v):
    rows, cells = ce.build_cells(v.embeddings, "vec_id", "embedding", 64)
    return rounded(ce.top_k_in_cells(queries_of(v), rows, cells, "vec_id", 10, skip_self=False)[0], "similarity")
