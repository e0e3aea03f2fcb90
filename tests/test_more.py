"""Remaining operator surface: weighted model averages, persistence, user metrics,
tf-idf SVM, run filters, evaluation modes, feature build, image report."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import metrics as M
from quarry.operators import models as MD
from quarry.operators import runs as RU
from quarry.plans import automl as A
from quarry.plans import report as RP


def _reg(spark, n=120):
    rng = np.random.default_rng(4)
    x = rng.normal(size=n)
    rows = [(i, float(a), float(3 * a + 1 + rng.normal() * 0.1)) for i, a in enumerate(x)]
    return MD.assemble(spark.createDataFrame(rows, "id long, x double, label double"), ["x"])


def test_weighted_average_models(spark):
    df = _reg(spark)
    stats = MD.data_stats(df)
    models = MD.weighted_average_fit(df, {
        "lin": MD.make_estimator("linear_regression", MD.REGRESSION, stats),
        "tree": MD.make_estimator("decision_tree_regressor", MD.REGRESSION, stats, maxDepth=3)})
    out = MD.weighted_average_predict(models, df, "id", {"lin": 3.0, "tree": 1.0})
    lin = {r["id"]: r["prediction"] for r in models["lin"].transform(df).collect()}
    tree = {r["id"]: r["prediction"] for r in models["tree"].transform(df).collect()}
    for r in out.collect():
        assert r["prediction"] == pytest.approx((3 * lin[r["key"]] + tree[r["key"]]) / 4)


def test_model_save_load(spark, tmp_dir):
    from pyspark.ml import Pipeline
    df = _reg(spark)
    model = Pipeline(stages=[MD.make_estimator("linear_regression", MD.REGRESSION, MD.data_stats(df))]).fit(df)
    path = os.path.join(tmp_dir, "m")
    MD.save_model(model, path)
    again = MD.load_pipeline(path)
    a = [r["prediction"] for r in model.transform(df).orderBy("id").collect()]
    b = [r["prediction"] for r in again.transform(df).orderBy("id").collect()]
    assert a == b


def test_user_metric(spark):
    df = _reg(spark)
    est = MD.make_estimator("linear_regression", MD.REGRESSION, MD.data_stats(df))
    _, score = MD.train_one(est, df, df, MD.REGRESSION, metric_fn=lambda y, p: F.max(F.abs(y - p)))
    assert 0 < score < 1
    pred = df.withColumn("prediction", F.col("label"))
    assert M.custom_metric(pred, lambda y, p: F.avg((y == p).cast("double"))).first()["score"] == 1.0


def test_tfidf_svm(spark):
    rows = [(i, "good great fine" if i % 2 else "bad awful poor", float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, label double")
    m = MD.make_estimator("tfidf_svm", MD.CLASSIFICATION, MD.data_stats(df, "label")).fit(df)
    acc = m.transform(df).select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc == 1.0


def test_runs_by(spark):
    runs = spark.createDataFrame([("r1", "v1", "a", "completed", "acc", 0.5),
                                  ("r2", "v2", "a", "completed", "acc", 0.6),
                                  ("r3", "v2", "b", "failed", "acc", 0.1)],
                                 "run_id string, version string, model string, status string, metric string, value double")
    assert RU.runs_by(runs, version="v2").count() == 2
    assert RU.runs_by(runs, model="a").count() == 2
    assert RU.runs_by(runs, version="v2", model="b").count() == 1


def test_evaluate_modes(spark):
    pred = spark.createDataFrame([(1, "a", "a"), (2, "b", "a"), (3, "b", "b")], "k int, label string, prediction string")
    full = A.evaluate(pred, MD.CLASSIFICATION, "k")
    assert set(full) == {"metrics", "confusion", "errors"} and full["errors"].count() == 1
    assert set(A.evaluate(pred, MD.CLASSIFICATION, "k", "quick")) == {"metrics", "confusion"}
    assert set(A.evaluate(pred, MD.CLASSIFICATION, "k", "failures_only")) == {"errors"}


def test_build_features_writes_parquet(spark, tmp_dir):
    df = spark.createDataFrame([(1.0, "x", 0), (None, "y", 1), (3.0, None, 0)], "n double, c string, target int")
    out, model, counts = A.build_features(df, out_path=os.path.join(tmp_dir, "f"))
    assert out.columns == ["target", "n", "c"] and counts["output_columns"] == 3
    assert spark.read.parquet(os.path.join(tmp_dir, "f")).count() == 3


def test_image_report(spark, tmp_dir):
    from test_images import _png
    os.makedirs(f"{tmp_dir}/a")
    _png(f"{tmp_dir}/a/x.png", 2, 2)
    rep = RP.image_report(spark, tmp_dir)
    assert rep.where("section = 'image_stats' AND metric = 'n_images'").first()["value"] == "1"


def test_cross_validate_expanding_window(spark):
    from quarry.operators import splits as SP
    df = _reg(spark, 60)
    folds = SP.time_series_folds(df, ["id"], 3)
    stats = MD.data_stats(folds)
    fs, summary = MD.cross_validate(folds, lambda: MD.make_estimator("linear_regression", MD.REGRESSION, stats),
                                    "test_fold", MD.REGRESSION, k=3, ordered=True)
    assert summary.first()["n_folds"] == 3
    # fold i trains only on rows before its test block
    n, size = 60, 60 // 4
    for i in range(3):
        start = n - (3 - i) * size
        tr = folds.where((F.col("train_from_fold") >= 0) & (F.col("train_from_fold") <= i))
        assert tr.agg(F.max("idx")).first()[0] == start - 1


def test_score_weighted_ensemble(spark):
    from quarry.operators import ensembles as EN
    a = spark.createDataFrame([(1, 10.0)], "k int, prediction double")
    b = spark.createDataFrame([(1, 20.0)], "k int, prediction double")
    out = EN.ensemble({"a": a, "b": b}, "k", "weighted", scores={"a": 0.75, "b": 0.25}).first()
    assert out["prediction"] == pytest.approx(12.5)
    avg = EN.ensemble({"a": a, "b": b}, "k", "stacking").first()
    assert avg["prediction"] == pytest.approx(15.0)


def test_operators_on_empty_frames(spark):
    from quarry.operators import metrics as MM
    from quarry.operators import profile as P
    from quarry.operators import series as S
    from quarry.operators import text as X
    e = spark.createDataFrame([], "label int, score double, prediction int")
    assert MM.roc_auc(e).first()["auc"] is None
    assert MM.classification_metrics(e).first()["n"] is None
    t = spark.createDataFrame([], "text string")
    assert X.vocabulary(t, "text").first()["total_words"] == 0
    assert X.top_words(t, "text").count() == 0
    s = spark.createDataFrame([], "ts timestamp, value double")
    assert S.trend(s).first()["n"] == 0
    assert P.quality_report(spark.createDataFrame([], "a int, b string")).first()["n_rows"] == 0
