"""kNN: bounded groups and copies where nothing is pruned; the screen loses no neighbour."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import knn as KNN


def brute(tv, tid, qv, k):
    d = np.sqrt(((qv[:, None] - tv[None]) ** 2).sum(axis=2))
    return [[int(tid[i]) for i in sorted(range(len(tid)), key=lambda i: (round(row[i], 9), tid[i]))[:k]] for row in d]


def test_screen_keeps_ties_and_far_points():
    rng = np.random.default_rng(3)
    t = rng.normal(size=(200, 6)) + 1e6
    t[50:90] = t[7]  # many copies
    q = np.vstack([t[:20], rng.normal(size=(5, 6)) + 1e6])
    row, col = KNN._screen(q, t, 5)
    near = KNN._exact(q, t, row, col)
    d = np.sqrt(((q[:, None] - t[None]) ** 2).sum(axis=2))
    for i in range(len(q)):
        kept = dict(zip(col[row == i].tolist(), near[row == i].tolist()))
        kth = np.sort(d[i])[4]
        assert set(np.flatnonzero(d[i] <= kth).tolist()) <= kept.keys()


def test_small_cells_share_blocks():
    """A vector that no cell rules out goes once to each block of rows, not once to each cell."""
    piv = np.random.default_rng(1).normal(size=(300, 8))
    first, n_sub, blocks = KNN._blocks_of({i: 10 for i in range(299)} | {299: 5000}, piv, 1000)
    assert blocks <= 2 * (2990 + 5000) / 1000 + 2 and n_sub[299] >= 5
    assert all(0 <= f and f + n <= blocks for f, n in zip(first, n_sub))
    assert KNN._blocks_of({}, piv, 10)[2] == 0


@pytest.mark.parametrize("method,block_rows", [("blocks", 70), ("pivots", 30), ("pivots", 10_000)])
def test_neighbours(spark, monkeypatch, method, block_rows):
    monkeypatch.setattr(KNN, "CHUNK_BYTES", 4096)  # many chunks
    rng = np.random.default_rng(5)
    v = rng.normal(size=(260, 7))
    v[40:60] = v[3]
    df = spark.createDataFrame([(i, x.tolist(), float(i % 3)) for i, x in enumerate(v)], "id long, v array<double>, label double")
    nb = KNN.neighbours(df.where("id >= 60"), df.where("id < 60"), 4, "id", "id", "v", "label", block_rows=block_rows, method=method)
    got = {}
    for r in nb.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["tid"])
    assert [got[i] for i in range(60)] == brute(v[60:], np.arange(60, 260), v[:60], 4)


def test_not_a_number(spark):
    nan, inf = float("nan"), float("inf")
    t = spark.createDataFrame([(1, [0.0], 0.0), (2, [inf], 0.0), (3, [2.0], 1.0)], "id long, v array<double>, label double")
    q = spark.createDataFrame([(7, [1.5]), (8, [nan])], "id long, v array<double>")
    nb = KNN.neighbours(t, q, 2, "id", "id", "v", "label", method="blocks")
    assert [(r["qid"], r["tid"]) for r in nb.orderBy("qid", "rank").collect()] == [(7, 3), (7, 1)]
    assert nb.where(F.col("qid") == 8).count() == 0
