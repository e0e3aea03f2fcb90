"""Exact splits against MLlib's depth-1 trees; regularisation paths against MLlib and the conditions of optimality."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from quarry.operators import linear_path as LP
from quarry.operators import models as MD
from quarry.operators import stumps as ST


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        a, b, d = int(rng.integers(0, 30)), float(rng.integers(0, 12)) / 4, 7.0
        rows.append((a, b, d, float(3 * (a > 11) + b + rng.normal()), ["x", "y", "z"][int((a + 3 * b + rng.integers(0, 9)) // 14) % 3]))
    return spark.createDataFrame(rows, "a int, b double, d double, y double, k string")


@pytest.mark.parametrize("task", [ST.REGRESSION, ST.CLASSIFICATION])
def test_stump_equals_depth_one_tree(spark, data, task):
    x = MD.assemble(data, ["a", "b", "d"])
    if task == ST.REGRESSION:
        label, tree = "y", DecisionTreeRegressor(maxDepth=1, maxBins=64, labelCol="y").fit(x)
    else:
        from pyspark.ml.feature import StringIndexer
        x = StringIndexer(inputCol="k", outputCol="ki").fit(x).transform(x)
        label, tree = "k", DecisionTreeClassifier(maxDepth=1, maxBins=64, labelCol="ki").fit(x)
    root = tree._call_java("rootNode")
    best = ST.best_splits(data, ["a", "b", "d"], label, task).orderBy("rank").collect()
    assert best[0]["feature"] == ["a", "b", "d"][root.split().featureIndex()]
    assert best[0]["threshold"] == pytest.approx(root.split().threshold())
    assert best[0]["gain"] == pytest.approx(root.gain())
    assert [r["feature"] for r in best] == ["a", "b"]  # a constant feature has no split


def test_stump_skips_missing_values(spark, data):
    dirty = data.unionByName(data.limit(5).withColumn("y", F.lit(None).cast("double"))).withColumn(
        "b", F.when(F.col("a") % 2 == 0, F.lit(float("nan"))).when(F.col("a") % 3 == 0, None).otherwise(F.col("b")))
    got = {r["feature"]: r for r in ST.best_splits(dirty, ["a", "b"], "y", ST.REGRESSION).collect()}
    kept = [(r["b"], r["y"]) for r in data.collect() if r["a"] % 2 and r["a"] % 3]
    assert got["b"]["n_left"] + got["b"]["n_right"] == len(kept)
    y = np.array([v for _, v in kept])
    gains = {}
    values = sorted({v for v, _ in kept})
    for lo, hi in zip(values, values[1:]):
        left = np.array([v <= lo for v, _ in kept])
        gains[(lo + hi) / 2] = y.var() - (left.mean() * y[left].var() + (~left).mean() * y[~left].var())
    assert got["b"]["threshold"] == max(gains, key=gains.get)
    assert got["b"]["gain"] == pytest.approx(max(gains.values()))
    assert ST.best_splits(data.limit(0), ["a"], "y", ST.REGRESSION).count() == 0


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 6)) * [1, 2, 3, 1, 5, 0] + rng.normal(size=(500, 1))
    x[:, 5] = 2.0
    y = x @ [2, -1, 0, 0.5, 0, 9] + rng.normal(size=500) + 10
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)],
                                 ", ".join(f"x{i} double" for i in range(6)) + ", label double"), x, y


@pytest.mark.parametrize("l1", [1.0, 0.5, 0.1])
def test_path_meets_the_optimality_conditions(wide, l1):
    df, x, y = wide
    g = LP.gram(df, [f"x{i}" for i in range(6)], "label")
    assert np.allclose(g.cov, np.cov(np.column_stack([x, y]).T, bias=True))
    for alpha, b, intercept in LP.path(g, l1=l1):
        slope = (x - x.mean(0)).T @ ((y - y.mean()) - (x - x.mean(0)) @ b) / len(y) - alpha * (1 - l1) * b
        live = b != 0
        assert np.allclose(slope[live], alpha * l1 * np.sign(b[live]), atol=1e-8)
        assert (np.abs(slope[~live]) <= alpha * l1 + 1e-8).all() and b[5] == 0
        assert intercept == pytest.approx(y.mean() - x.mean(0) @ b)


@pytest.mark.parametrize("name, l1", [("lasso_regression", 1.0), ("elastic_net", 0.5)])
def test_path_equals_the_catalogue_model(spark, wide, name, l1):
    df, _, _ = wide
    cols = [f"x{i}" for i in range(5)]
    xs = MD.assemble(df, cols)
    g = LP.gram(df, cols, "label")
    for alpha in (0.01, 0.3, 1.0):
        model = MD.make_estimator(name, MD.REGRESSION, MD.data_stats(xs), alpha=alpha, tol=1e-12, maxIter=1000).fit(xs)
        (_, b, intercept), = LP.path(g, [alpha], l1)
        assert np.allclose(model.coefficients.toArray(), b, atol=1e-5)
        assert model.intercept == pytest.approx(intercept, abs=1e-4)


def test_path_of_dirty_and_empty_tables(spark, wide):
    df, x, y = wide
    dirty = df.unionByName(df.limit(3).withColumn("x0", F.lit(float("nan")))).unionByName(df.limit(2).withColumn("label", F.lit(None).cast("double")))
    assert LP.gram(dirty, ["x0"], "label").n == 500
    empty = LP.path_frame(spark, LP.gram(df.limit(0), ["x0", "x1"], "label"), [1.0]).collect()
    assert [(r["feature"], r["coefficient"], r["intercept"]) for r in empty] == [("x0", None, None), ("x1", None, None)]
