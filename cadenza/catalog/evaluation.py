"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.catalog import views as vw
from cadenza.catalog.registry import half_up as hu
from cadenza.catalog.registry import query, rounded
from cadenza.catalog.vectors import cells
from cadenza.operators import evaluation as ev
from cadenza.plans import evaluation as job

D = vw.DUCK
S = vw.SHARED


@query("zscore_by_reference", f"""
    WITH r AS (SELECT dim, avg(value) AS m, stddev_pop(value) AS s FROM {{vec_cells}} GROUP BY dim)
    SELECT vec_id, dim, {hu('(value - m) / (s + 1e-10)')} AS plain, {hu('(value - m) / CASE WHEN s < 1e-6 THEN 1.0 ELSE s END')} AS guarded FROM {{vec_cells}} JOIN r USING (dim)""")
def zscore_by_reference(v):
    long = v.vectors.select("vec_id", "seq", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))
    ref = long.select("dim", "value")
    plain = ev.zscore_by_reference(long.select("vec_id", "dim", "value"), ref, "dim", "value")
    both = ev.zscore_by_reference(
        long.select("vec_id", "dim", "value"), ref, "dim", "value", eps=None
    ).withColumnRenamed("value", "guarded").join(plain.withColumnRenamed("value", "plain"), ["vec_id", "dim"])
    return rounded(both.select("vec_id", "dim", "plain", "guarded"), "plain", "guarded")


@query("frechet_distance")
def frechet_distance(v):
    generated = v.vectors.select("seq", "embedding")
    out = ev.frechet_distance(generated, v.vectors.select("embedding"), "seq", "embedding", 64)
    return rounded(out, "frechet", digits=4)


# two dimensions have a closed form: the trace of the root of a 2 x 2 product is sqrt(trace + 2 sqrt(determinant))
@query("frechet_distance_plane", f"""
    WITH xy AS (SELECT seq, CAST(embedding[1] AS DOUBLE) + 1e6 AS x, CAST(embedding[2] AS DOUBLE) - 1e6 AS y FROM {{vectors}}),
    g AS (SELECT CAST(seq AS VARCHAR) AS seq, count(*) AS n, avg(x - 1e6) AS mx, avg(y + 1e6) AS my, var_samp(x - 1e6) AS a, covar_samp(x - 1e6, y + 1e6) AS b, var_samp(y + 1e6) AS c FROM xy GROUP BY 1),
    r AS (SELECT avg(x - 1e6) AS rx, avg(y + 1e6) AS ry, var_samp(x - 1e6) AS d, covar_samp(x - 1e6, y + 1e6) AS e, var_samp(y + 1e6) AS f FROM xy)
    SELECT seq, n, {hu('(mx - rx) ** 2 + (my - ry) ** 2 + a + c + d + f - 2 * sqrt(a * d + 2 * b * e + c * f + 2 * sqrt((a * c - b * b) * (d * f - e * e)))', 4)} AS frechet
    FROM g, r WHERE n > 1""")
def frechet_distance_plane(v):
    far = v.vectors.select("seq", F.array(F.col("embedding")[0].cast("double") + 1e6, F.col("embedding")[1].cast("double") - 1e6).alias("xy"))
    return rounded(ev.frechet_distance(far, far.select("xy"), "seq", "xy", 2), "frechet", digits=4)


@query("mean_pairwise_distance", f"""
    SELECT CAST(a.seq AS VARCHAR) AS seq, any_value(n) AS n, {hu('sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / ((any_value(n) * any_value(n) - any_value(n)) / 2)')} AS distance
    FROM {{vectors}} a JOIN {{vectors}} b ON a.seq = b.seq AND a.pos < b.pos JOIN (SELECT seq, count(*) AS n FROM {{vectors}} GROUP BY seq) c ON c.seq = a.seq GROUP BY a.seq
    UNION ALL SELECT 'all', any_value(n), {hu('sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / ((any_value(n) * any_value(n) - any_value(n)) / 2)')}
    FROM {{vectors}} a JOIN {{vectors}} b ON a.vec_id < b.vec_id, (SELECT count(*) AS n FROM {{vectors}})""")
def mean_pairwise_distance(v):
    per = ev.mean_pairwise_distance(v.vectors, "seq", "pos", "embedding")
    every = ev.mean_pairwise_distance(v.embeddings.withColumn("seq", F.lit("all")), "seq", "vec_id", "embedding")
    return rounded(per.unionByName(every), "distance")


S["codes"] = "SELECT event_id, CAST(floor(value) AS BIGINT) AS code FROM {events}"


@query("code_histogram", """
    SELECT b AS code, count(code) AS n FROM (SELECT unnest(range(512)) AS b) LEFT JOIN {codes} ON code = b GROUP BY b""")
def code_histogram(v):
    return ev.code_histogram(v.codes, "code", 512)


@query("loss_log_series", """
    SELECT CAST(regexp_extract(line, 'updates.([0-9]+)', 1) AS BIGINT) AS iteration,
           least(30.0, CAST(regexp_extract(line, 'loss.([0-9.]+)', 1) AS DOUBLE)) AS loss FROM {log_lines} WHERE contains(line, 'update')
    QUALIFY row_number() OVER (PARTITION BY regexp_extract(line, 'updates.([0-9]+)', 1) ORDER BY line_no DESC, line DESC) = 1""")
def loss_log_series(v):
    lines = v.log_lines.select("line", F.struct("line_no", "line").alias("at"))
    return ev.loss_series(lines, "line", "at", 30.0)


@query("mean_loss_perplexity", f"SELECT {hu('avg(l_discount * 30)')} AS mean_loss, {hu('exp(avg(l_discount * 30))')} AS perplexity FROM {{lineitem}}")
def mean_loss_perplexity(v):
    return rounded(ev.mean_loss(v.lineitem.select((F.col("l_discount") * 30).alias("loss")), "loss"), "mean_loss", "perplexity")


METRICS = ("fid_k", "fid_g", "div_k", "div_g")

D["computed"] = """
    SELECT experiment, epoch, avg(price) FILTER (status = 'F') AS fid_k, max(price) AS fid_g, min(price) AS div_k, CAST(count(*) AS DOUBLE) AS div_g,
           CASE WHEN min(price) < 1010 THEN 'failed: price ' || CAST(CAST(floor(min(price)) AS BIGINT) AS VARCHAR) END AS error FROM {experiments} GROUP BY ALL"""


D["board"] = f"""
    WITH old AS (SELECT experiment, epoch, min(price) AS fid_k FROM {{experiments}} WHERE status = 'P' AND price > 400000 GROUP BY ALL)
    SELECT experiment, epoch, {hu('fid_k', 4)} AS fid_k, {hu('fid_g', 4)} AS fid_g, {hu('div_k', 4)} AS div_k, {hu('div_g', 4)} AS div_g, error FROM (
        SELECT experiment, epoch, fid_k, 0.0 AS fid_g, 0.0 AS div_k, 0.0 AS div_g, NULL AS error FROM old
        UNION ALL SELECT experiment, epoch, fid_k, fid_g, div_k, div_g, error FROM {{computed}} c WHERE NOT EXISTS (FROM old o WHERE o.experiment = c.experiment AND o.epoch = c.epoch))"""


@query("experiment_board", "SELECT * FROM {board}")
def experiment_board(v):
    e = v.experiments
    keys = ["experiment", "epoch"]
    finished = e.filter("status = 'P' AND price > 400000").groupBy(*keys).agg(F.min("price").alias("fid_k")).select(
        *keys, "fid_k", *[F.lit(0.0).alias(m) for m in METRICS[1:]], F.lit(None).cast("string").alias("error"))
    wide = e.groupBy(*keys).agg(
        F.avg(F.when(F.col("status") == "F", F.col("price"))).alias("fid_k"), F.max("price").alias("fid_g"),
        F.min("price").alias("div_k"), F.count(F.lit(1)).cast("double").alias("div_g"), F.min("price").alias("_low"))
    failed = F.when(F.col("_low") < 1010, F.concat(F.lit("failed: price "), F.floor("_low").cast("string")))
    computed = wide.select(*keys, failed.alias("error"), F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("_m")).select(*keys, "error", "_m.*")
    return rounded(ev.experiment_board(finished, computed, METRICS), *METRICS, digits=4)


@query("chart_series", """
    SELECT experiment, CAST(regexp_extract(epoch, '(\\d+)', 1) AS BIGINT) AS epoch, fid_k, fid_g, div_k, div_g FROM {board} WHERE error IS NULL""")
def chart_series(v):
    return ev.chart_series(experiment_board(v), METRICS)


@query("evaluation_job")
def evaluation_job(v):
    """Vectors stand for features: the first eight dimensions are kinetic, the next eight geometric; labels are epochs."""
    part = lambda kind, start: v.embeddings.select(
        F.concat(F.lit("run"), (F.col("vec_id") % 2).cast("string")).alias("experiment"), F.concat(F.lit("ep"), F.col("label").cast("string")).alias("epoch"),
        F.col("vec_id").alias("seq"), F.lit(kind).alias("kind"), F.transform(F.slice("embedding", start, 8), lambda x: x.cast("double")).alias("vector"))
    features = part("kinetic", 1).unionByName(part("geometric", 9))
    finished = v.spark.createDataFrame([("run0", "ep0", 0.0, 0.0, 0.0, 0.0, None)],
                                       "experiment string, epoch string, fid_k double, div_k double, fid_g double, div_g double, error string")
    board = job.evaluate(features, features.drop("experiment", "epoch"), finished, {"kinetic": 8, "geometric": 8})
    return rounded(board, "fid_k", "div_k", "fid_g", "div_g", digits=4)
