"""Metrics, ensembles, splits."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import ensembles as EN
from quarry.operators import metrics as M
from quarry.operators import splits as SP


def test_never_predicted_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 0)], "label int, prediction int")
    pc = {r["class"]: r for r in M.per_class(df).collect()}
    assert pc["2"]["precision"] == 0.0 and pc["2"]["recall"] == 0.0
    m = M.classification_metrics(df).first()
    assert m["accuracy"] == 0.5
    # weighted precision: (1 * 0.5 + 1 * 0.5 + 2 * 0) / 4
    assert m["precision"] == pytest.approx(0.25)


def test_auc_ties_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert M.roc_auc(df).first()["auc"] == 0.5


def test_auc_matches_rank_formula(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 2)  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    import pandas as pd
    ranks = pd.Series(s).rank(method="average").to_numpy()
    pos = y == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert M.roc_auc(df).first()["auc"] == pytest.approx(auc)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "label double, prediction double")
    m = M.regression_metrics(df).first()
    assert m["mse"] == pytest.approx((0.25 + 0 + 1) / 3)
    assert m["r2"] == pytest.approx(1 - ((0.25 + 1) / 3) / (2 / 3))


def test_cv_summary_population_std(spark):
    s = spark.createDataFrame([(0, 1.0), (1, 3.0)], "fold int, score double")
    r = M.cv_summary(s).first()
    assert r["mean_score"] == 2.0 and r["std_score"] == 1.0 and r["n_folds"] == 2


def test_weighted_ensemble_joins_by_name(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 20.0)], "k int, prediction double")
    b = spark.createDataFrame([(1, 0.0), (2, 0.0)], "k int, prediction double")
    out = {r["key"]: r["prediction"] for r in
           EN.ensemble({"a": a, "b": b}, "k", weights={"b": 3.0, "a": 1.0}).collect()}
    assert out == {1: 2.5, 2: 5.0}


def test_split_hash_matches_duckdb(spark):
    import duckdb
    from quarry.functions.hashing import key_hash_sql
    df = spark.range(200).withColumnRenamed("id", "k")
    got = {r["k"]: r["split"] for r in SP.holdout(df, "k").collect()}
    sql = f"SELECT k, CASE WHEN {key_hash_sql('k')} % 1000 < 200 THEN 'valid' ELSE 'train' END FROM range(200) t(k)"
    want = dict(duckdb.sql(sql).fetchall())
    assert got == want


def test_stratified_folds_balanced(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(100)], "k long, y int")
    f = SP.stratified_kfold(df, "k", "y", 5).groupBy("y", "fold").count().collect()
    assert all(r["count"] == 10 for r in f)


def test_time_series_folds(spark):
    import numpy as np
    df = spark.createDataFrame([(i,) for i in range(12)], "t long")
    out = {r["t"]: r for r in SP.time_series_folds(df, ["t"], 5).collect()}
    # n = 12, test size 2: fold i tests [2 + 2i, 4 + 2i)
    assert [out[t]["test_fold"] for t in range(12)] == [None, None, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert out[0]["train_from_fold"] == 0 and out[3]["train_from_fold"] == 1
    assert out[11]["train_from_fold"] is None


def test_sample_exact_size(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert SP.sample_rows(df, "k", 100).count() == 100
    assert SP.sample_rows(df, "k", 5000).count() == 1000
