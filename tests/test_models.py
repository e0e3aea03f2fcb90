"""Model operators: closed forms, kNN against brute force, isolation forest, CV."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import isoforest as ISO
from quarry.operators import knn as KNN
from quarry.operators import models as MD
from quarry.operators import splits as SP


def _xy(spark, n=200):
    rng = np.random.default_rng(0)
    x = rng.normal(size=n) * 3 + 1
    y = 2.5 * x + rng.normal(size=n) + 4
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                                 "id long, x double, label double"), x, y


def test_ridge_matches_closed_form(spark):
    df, x, y = _xy(spark)
    df = MD.assemble(df, ["x"])
    m = MD.make_estimator("ridge_regression", MD.REGRESSION, MD.data_stats(df)).fit(df)
    sxy = ((x - x.mean()) * (y - y.mean())).sum()
    sxx = ((x - x.mean()) ** 2).sum()
    assert m.coefficients[0] == pytest.approx(sxy / (sxx + 1.0), rel=1e-8)


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(120, 4))
    labels = rng.integers(0, 3, 120)
    rows = [(i, [float(v) for v in p], int(l)) for i, (p, l) in enumerate(zip(pts, labels))]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    train, test = df.where("id >= 30"), df.where("id < 30")
    nb = KNN.neighbours(train, test, 5, "id", "id", "vec", "label", block_rows=16)
    got = {r["qid"]: r["prediction"] for r in KNN.vote(nb).collect()}
    for q in range(30):
        d = np.sqrt(((pts[30:] - pts[q]) ** 2).sum(axis=1))
        idx = np.lexsort((np.arange(30, 120), d))[:5]
        votes = np.bincount(labels[30:][idx], minlength=3)
        assert got[q] == int(np.argmax(votes))


def test_isolation_forest_flags_outlier(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(v)) for i, v in enumerate(rng.normal(size=300))] + [(999, 50.0)]
    df = spark.createDataFrame(rows, "id long, x double")
    forest = ISO.fit(df, ["x"], "id", n_trees=20, max_samples=64)
    scores = {r["id"]: r["anomaly_score"] for r in ISO.score(df, forest).collect()}
    assert scores[999] == max(scores.values())


def test_isolation_forest_samples_the_lowest_hashes_of_all_rows(spark):
    """With many more rows than a sample, and missing values as the median."""
    from pyspark.sql import functions as F
    df = spark.range(6000).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 7 + F.rand(1)).alias("x"))
    a = ISO.fit(df, ["x"], "id", n_trees=5, max_samples=16)
    b = ISO.fit(df.repartition(9), ["x"], "id", n_trees=5, max_samples=16)
    assert len(a["trees"]) == 5 and all(t["s"][0] == 16 for t in a["trees"])
    assert [t["s"] for t in a["trees"]] == [t["s"] for t in b["trees"]]
    scores = ISO.score(df.where("x is null or id = 5"), a).select("anomaly_score").distinct().collect()
    assert len(scores) <= 2 and a["medians"]["x"] is not None


def test_auc_falls_back_by_name(spark):
    from pyspark.ml.linalg import Vectors
    rows = [(float(i % 3), float(i % 3), Vectors.dense([0.1, 0.2, 0.7])) for i in range(9)]
    pred = spark.createDataFrame(rows, ["label", "prediction", "probability"])
    assert MD.metric_in_use(pred, MD.CLASSIFICATION, "auc") == "accuracy"
    assert MD.score_predictions(pred, MD.CLASSIFICATION, "auc") == 1.0
    two = spark.createDataFrame([(float(i % 2), 0.0, Vectors.dense([1 - i / 9, i / 9])) for i in range(9)], pred.schema)
    assert MD.metric_in_use(two, MD.CLASSIFICATION, "auc") == "auc"


def test_cross_validate_and_ranking(spark):
    df, _, _ = _xy(spark)
    df = SP.kfold(MD.assemble(df, ["x"]), "id", 3)
    stats = MD.data_stats(df)
    fs, summary = MD.cross_validate(df, lambda: MD.make_estimator("linear_regression", MD.REGRESSION, stats),
                                    "fold", MD.REGRESSION, k=3)
    assert summary.first()["n_folds"] == 3
    run = MD.train_models(df.where("fold != 0"), df.where("fold = 0"),
                          ["linear_regression", "no_such_model"], MD.REGRESSION)
    assert run.rankings(spark).count() == 1 and run.errors(spark).count() == 1


def test_hybrid_adds_residual_model(spark):
    df, _, _ = _xy(spark)
    df = MD.assemble(df.withColumn("g", (F.col("id") % 2).cast("string")), ["x"])
    base = MD.make_estimator("linear_regression", MD.REGRESSION, MD.data_stats(df))
    out = MD.hybrid_fit(df, base, MD.GroupMeanRegressor(groupCol="g")).transform(df)
    r = out.select((F.col("prediction") - F.col("base_prediction") - F.col("residual_prediction")).alias("d"))
    assert r.agg(F.max(F.abs("d"))).first()[0] == pytest.approx(0.0, abs=1e-9)


def test_tune_grid(spark):
    df, _, _ = _xy(spark)
    df = SP.kfold(MD.assemble(df, ["x"]), "id", 3)
    est = MD.make_estimator("ridge_regression", MD.REGRESSION, MD.data_stats(df))
    best, table = MD.tune(est, {"regParam": [0.0, 0.1, 10.0]}, df, MD.REGRESSION, "fold")
    assert table.count() == 3 and best is not None


def test_catalogue_builds_every_name(spark):
    stats = MD.DataStats(n=100, label_std=2.0, n_classes=2)
    for name, (tasks, factory) in MD.CATALOGUE.items():
        for task in tasks:
            assert MD.make_estimator(name, task, stats) is not None, name


def test_word_count_histogram(spark):
    from quarry.operators import text as X
    df = spark.createDataFrame([("a b c",), ("a",), ("",)], "text string")
    h = X.word_count_histogram(df, "text", 3).where("count > 0").collect()
    assert sum(r["count"] for r in h) == 3


def test_knn_pivots_exact_against_brute_force(spark):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(6, 3)) * 10
    pts = np.vstack([c + rng.normal(size=(60, 3)) for c in centers])
    pts[:90] = pts[0]  # one heavy cell: many identical vectors (hot key)
    labels = rng.integers(0, 4, len(pts))
    rows = [(i, [float(v) for v in p], int(l)) for i, (p, l) in enumerate(zip(pts, labels))]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    train, test = df.where("id % 7 <> 0"), df.where("id % 7 = 0")
    nb = KNN.neighbours_pivots(train, test, 5, "id", "id", "vec", "label", n_pivots=12, block_rows=8)
    got = {}
    for r in nb.collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["tid"], round(r["dist"], 9)))
    tr_ids = np.array([i for i in range(len(pts)) if i % 7 != 0])
    for q in [i for i in range(len(pts)) if i % 7 == 0]:
        d = np.sqrt(((pts[tr_ids] - pts[q]) ** 2).sum(axis=1))
        order = np.lexsort((tr_ids, d))[:5]
        want = [(i + 1, int(tr_ids[j]), round(float(d[j]), 9)) for i, j in enumerate(order)]
        assert sorted(got[q]) == want
