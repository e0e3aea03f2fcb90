"""Isolation forest: rows walk down flat trees, hashes are drawn for whole batches."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import isoforest as ISO


def walk(tree, x):
    i = depth = 0
    while tree["f"][i] >= 0:
        i = tree["l"][i] if x[tree["f"][i]] < tree["t"][i] else tree["r"][i]
        depth += 1
    return depth + ISO._c(tree["s"][i])


def test_flat_walk():
    x = np.random.default_rng(2).normal(size=(300, 3))
    x[10:40] = x[1]
    for tree in (ISO._grow(x, 1, 4, 9), ISO._grow(x[:1], 1, 0, 3)):
        got = ISO._path_lengths(ISO._flat(tree), x)
        assert got.tolist() == [walk(tree, row) for row in x]


def test_samples_take_the_lowest_hashes(spark):
    import hashlib

    n, m, trees, seed = 3000, 16, 3, 9
    df = spark.range(n).select("id", (F.col("id") % 97).cast("double").alias("v")).union(spark.sql("select cast(null as long), 5.0D"))
    forest = ISO.fit(df, ["v"], "id", n_trees=trees, max_samples=m, seed=seed)
    digest = [hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i in range(n)]
    for t in range(trees):
        h = [((int(d[:12], 16) + t * int(d[12:24], 16)) % ISO.HASHES, i) for i, d in enumerate(digest)]
        keys = sorted(i for _, i in sorted(h)[:m])
        x = np.array([[i % 97] for i in keys], dtype=float)
        assert forest["trees"][t] == ISO._grow(x, seed, t, 4)
