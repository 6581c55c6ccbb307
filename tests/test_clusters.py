"""k-means of every sequence against a loop over the sequences from the same starts."""

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import clusters


def loop(x, starts, k):
    """Lloyd's rounds in numpy from each start; labels of the cheapest."""
    best = None
    for c in starts:
        c = c.copy()
        for _ in range(300):
            label = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(len(c))])
            rests = np.abs(new - c).max() <= 1e-9 * (1 + np.abs(c).max())
            c = new
            if rests:
                break
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        cost = round(d.min(axis=1).sum(), 9)
        if best is None or cost < best[0]:
            best = (cost, d.argmin(axis=1))
    return best[1].tolist()


def test_labels_equal_a_loop_over_sequences(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    sizes = {"long": 300, "short": 3, "one": 1, "equal": 20}
    data = {s: np.round(rng.normal(size=(n, 3)) + rng.integers(0, 4, size=(n, 1)) * 5, 3) for s, n in sizes.items()}
    data["equal"][:] = 1.5
    rows = [(s, i, v.tolist()) for s, x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, ("long", 900, None), (None, 0, [1.0, 2.0, 3.0])], "s string, i int, v array<double>")
    drawn = {}
    for r in clusters._starts(df.filter("v IS NOT NULL AND s IS NOT NULL"), "s", ["i"], "v", 4, 3, 42).collect():
        drawn.setdefault(r.s, {})[r.start] = np.array(r.centroids)
    got = {(r.s, r.i): r.label for r in clusters.cluster_each(df, "s", ["i"], "v", k=4, starts=3).collect()}
    assert len(got) == len(rows)
    for s, x in data.items():
        assert [got[s, i] for i in range(len(x))] == loop(x, [drawn[s][j] for j in range(3)], 4), s
    assert len({got["long", i] for i in range(300)}) == 4
    assert clusters.cluster_each(df.filter(F.lit(False)), "s", ["i"], "v").count() == 0
