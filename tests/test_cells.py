"""The pruned search gives the rows of a scan and looks at few of them."""

import numpy as np

from cadenza.operators import cells as ce
from cadenza.operators import vectors as ve

SCHEMA = "vec_id long, embedding array<double>"


def clustered(n, groups=30, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 16)) * 4
    # a third of all rows lie in one group
    group = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, groups, n))
    return [(i, [float(x) for x in centres[g] + rng.normal(size=16) * 0.2]) for i, g in enumerate(group)]


def test_same_rows_as_the_scan(spark):
    rows = clustered(3_000) + [(3_000, None), (3_001, [1.0] * 15 + [float("nan")])]
    rows += [(4_000 + i, rows[7][1]) for i in range(12)]  # ties go to the smaller key
    lib = spark.createDataFrame(rows, SCHEMA)
    asked = lib.filter("vec_id % 60 = 7").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    indexed, cells = ce.build_cells(lib, "vec_id", "embedding", 40)
    assert indexed.count() == len(rows) - 2
    for own in (True, False):
        # a cell of 100 rows and more is cut
        got, looked = ce.top_k_in_cells(asked, indexed, cells, "vec_id", 10, own, part_rows=100)
        want = ve.top_k_per_query(asked, lib.filter("vec_id NOT IN (3000, 3001)"), "vec_id", "embedding", 10, own)
        listed = lambda df: sorted((r.query_id, r.rank, r.vec_id, r.similarity) for r in df.collect())
        assert listed(got) == listed(want)
        share = looked.selectExpr("sum(looked_at) / sum(all_rows) AS s").first().s
        assert share < 0.3, share


def test_few_rows_and_none(spark):
    lib = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], SCHEMA)
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (9, None), (8, [0.0, 0.0])], "query_id long, query_vector array<double>")
    got, looked = ce.top_k_in_cells(asked, *ce.build_cells(lib, "vec_id", "embedding", 4), "vec_id", 5)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 1.0), (8, 1, 1, 0.0), (8, 2, 2, 0.0)]
    assert {r.looked_at for r in looked.collect()} == {2}
    empty = ce.build_cells(lib.limit(0), "vec_id", "embedding", 4)
    assert ce.top_k_in_cells(asked, *empty, "vec_id", 5)[0].count() == 0
