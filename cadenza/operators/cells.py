"""Exact search of the most similar vectors with cells that need not be looked at."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.vectors import dot, norm
from cadenza.sources.scratch import checkpointed

#: Rows of a cell that one task of a search takes; larger cells are cut.
PART_ROWS = 50_000
#: What rounding may add to a bound, relative to the lengths in it.
SLACK = 1e-9


def _whole(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def build_cells(vectors: DataFrame, key: str, vector: str, cells: int = 256, sample: int = 50_000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(rows, cells)``: every vector with the cell of its nearest centre, and each cell's centre, radius and rows.

    The centres are fitted on the ``sample`` rows of the smallest hashes of their key; every row is indexed.  Vectors that
    are null or hold null or non-finite entries lie in no cell.  Both tables are stored when this is called.
    """
    whole = vectors.filter(_whole(vector)).select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    drawn = checkpointed(whole.orderBy(F.xxhash64("id"), "v").limit(sample))
    centres = []
    if drawn.limit(1).count():
        model = KMeans(k=cells, maxIter=5, seed=seed, featuresCol="f").fit(drawn.select(array_to_vector("v").alias("f")))
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    table = vectors.sparkSession.createDataFrame(centres, "cell int, centre array<double>")
    packed = table.agg(F.collect_list(F.struct("cell", "centre")).alias("_all"))
    far = lambda c: F.sqrt(F.aggregate(F.zip_with("v", c["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    nearest = F.array_min(F.transform("_all", lambda c: F.struct(far(c).alias("far"), c["cell"].alias("cell"))))
    # one broadcast row of at most `cells` centres
    placed = whole.join(F.broadcast(packed)).select("id", "v", nearest.alias("_n")).select("id", "v", "_n.cell", "_n.far")
    stored = checkpointed(placed)
    sizes = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    return stored, checkpointed(sizes.join(F.broadcast(table), "cell"))


def top_k_in_cells(queries: DataFrame, rows: DataFrame, cells: DataFrame, key: str, k: int, skip_self: bool = True,
                   part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """The ``k`` most similar vectors of every query, as an exact scan gives them, and what was looked at.

    Returns ``(query_id, rank, key, similarity)`` and ``(query_id, looked_at, all_rows)``.  By Cauchy and Schwarz no vector of a cell
    is more similar to a query than ``q . centre + |q| * radius``.  A query first takes the cells with the most similar
    centres until they hold ``k`` rows; its k-th best there is a lower bound, and of the other cells only those
    that can reach it are searched.  Ties go to the smaller key.  Queries that are null or hold null or non-finite entries
    find nothing.  ``query_id`` must be unique; ``skip_self`` leaves out the row whose key is the query's.
    """
    ask = queries.filter(_whole("query_vector")).select("query_id", F.transform("query_vector", lambda x: x.cast("double")).alias("q"))
    packed = cells.agg(F.collect_list(F.struct("cell", "n", "radius", "centre")).alias("_all"), F.sum("n").alias("all_rows"))
    length = norm(F.col("q"))
    judged = F.transform("_all", lambda c: F.struct(
        dot(F.col("q"), c["centre"]).alias("near"), c["cell"].alias("cell"), c["n"].alias("n"),
        (dot(F.col("q"), c["centre"]) + length * c["radius"] + (length * (norm(c["centre"]) + c["radius"])) * SLACK).alias("bound")))
    ranked = ask.join(F.broadcast(packed)).select("query_id", "q", "all_rows", F.sort_array(judged, asc=False).alias("_c"))
    # cells in the order of their centres, each with the rows before it; a list of a few hundred entries
    before = F.aggregate("_c", F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("out")), lambda acc, c: F.struct(
        (acc["n"] + c["n"]).alias("n"), F.concat(acc["out"], F.array(acc["n"])).alias("out")))["out"]
    told = ranked.select("query_id", "q", "all_rows", F.explode(F.arrays_zip(F.col("_c").alias("c"), before.alias("before"))).alias("_z"))
    pairs = checkpointed(told.select("query_id", "q", "all_rows", "_z.c.cell", "_z.c.n", "_z.c.bound",
                                     (F.col("_z.before") < k + int(skip_self)).alias("first")))
    # large cells are cut by a hash of the key, so no task takes a whole one
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / part_rows)).cast("int")
    library = rows.join(F.broadcast(cells.select("cell", parts.alias("_parts"))), "cell").select(
        "cell", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("_part"), "id", "v")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")

    def search(wanted: DataFrame) -> DataFrame:
        spread = wanted.select("query_id", "q", "cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
        met = library.join(spread, ["cell", "_part"])
        if skip_self:
            met = met.filter(~F.col("id").eqNullSafe(F.col("query_id")))
        scored = met.select("query_id", "id", dot(F.col("v"), F.col("q")).alias("similarity"))
        # the rank filter is applied in every task before the exchange
        return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")

    start = checkpointed(search(pairs.filter("first")))
    least = start.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("least"))
    judged_pairs = pairs.join(least, "query_id", "left")
    open_cells = ~F.col("first") & (F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    found = start.unionByName(search(judged_pairs.filter(open_cells)))
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    looked = judged_pairs.groupBy("query_id").agg(
        F.coalesce(F.sum(F.when(F.col("first") | open_cells, F.col("n"))), F.lit(0)).alias("looked_at"), F.first("all_rows").alias("all_rows"))
    return top.select("query_id", "rank", F.col("id").alias(key), "similarity"), looked
