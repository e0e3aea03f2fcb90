import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import topk


def brute(rows, k, every):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))
            out |= {(q, r, i, -m) for r, (m, i) in enumerate(s[:k], 1)}
    return out


def search(spark, rows, k=10, every=10, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    q = topk.quantised(df, "vec_id", "embedding")
    return {tuple(r) for r in topk.top_k(q, q.where(F.col("id") % every == 0), k, **options).collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 12))
    rows = [(i, [float(x) for x in centres[i % 5] + 0.3 * rng.normal(size=12)]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # one vector many times: ties
    rows += [(2000, None), (2010, []), (2020, [float("nan")] * 12), (2030, [1.0, None]), (2040, [float("inf")] * 12),
             (2050, [1.0, 2.0]), (2060, [3.0, -2.0]), (None, [1.0] * 12), (2070, [0.0] * 12)]
    assert search(spark, rows, block_rows=16, blocks_per_task=4, queries_per_task=20) == brute(rows, 10, 10)


def test_pruning_skips_blocks_and_keeps_ties():
    rng = np.random.default_rng(1)
    m = np.concatenate([rng.integers(500, 900, (64, 8)), rng.integers(-900, -500, (640, 8))]).astype(np.int64)
    blocks = [(np.arange(a, a + 32), m[a:a + 32].max(0), m[a:a + 32].min(0), m[a:a + 32]) for a in range(0, len(m), 32)]
    found, scored = topk.visit(np.array([5]), m[5:6], blocks, 10)
    s = m @ m[5]
    want = sorted((-int(x), i) for i, x in enumerate(s) if i != 5)[:10]
    assert [(i, x) for _, i, x in found] == [(i, -x) for x, i in want] and scored <= 3


def test_large_components_are_exact():
    q = np.array([[2 ** 40, -3]], dtype=np.int64)
    rows = np.array([[2 ** 20, 1], [2 ** 20, 0]], dtype=np.int64)
    found, _ = topk.visit(np.array([9]), q, [(np.array([1, 2]), rows.max(0), rows.min(0), rows)], 2)
    assert found == [(9, 2, 2 ** 60), (9, 1, 2 ** 60 - 3)]


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0]), (0, [1.0]), (5, [3.0])]])
def test_few_rows(spark, rows):
    assert search(spark, rows) == brute(rows, 10, 10)
