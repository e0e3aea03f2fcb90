"""Groups without a name keep their rows on every path; multinomial models take any numbers."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import models as MD
from quarry.operators import series as S
from quarry.operators.ordering import row_index


@pytest.mark.parametrize("rows_per_range", [1000, 2])
def test_row_index(spark, rows_per_range):
    df = spark.createDataFrame([("a", 3), ("a", 1), (None, 5), (None, 4), (None, 9), ("b", 0)], "g string, x int")
    got = sorted((str(r["g"]), r["x"], r["i"]) for r in row_index(df, ["x"], ["g"], out="i", rows_per_range=rows_per_range).collect())
    assert got == [("None", 4, 0), ("None", 5, 1), ("None", 9, 2), ("a", 1, 0), ("a", 3, 1), ("b", 0, 0)]


def test_series_without_a_name(spark):
    df = spark.range(60).select(F.when(F.col("id") % 2 == 0, F.lit("s")).alias("k"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"),
                                (F.col("id") * F.col("id") % 7).cast("double").alias("value"))
    series = S.as_series(df, "ts", "value", ["k"])
    assert {r["k"]: r["n"] for r in S.stationarity(series, ["k"]).collect()} == {"s": 30, None: 30}


def test_multinomial_nb_on_scaled_features(spark):
    rows = [(float(i % 2), float(i % 2) * 2 - 1, float(i % 5)) for i in range(40)]
    df = MD.assemble(spark.createDataFrame(rows, "label double, a double, b double"), ["a", "b"])
    run = MD.train_models(df, df, ["multinomial_nb"], MD.CLASSIFICATION)
    assert run.results[0].error is None and run.results[0].score == 1.0
    # Counts as they are: the plain model.
    from pyspark.ml.classification import NaiveBayes
    plain = MD.assemble(spark.createDataFrame(rows, "label double, a double, b double").withColumn("a", F.col("a") + 1), ["a", "b"])
    a = MD.make_estimator("multinomial_nb", MD.CLASSIFICATION, MD.data_stats(plain)).fit(plain).transform(plain)
    b = NaiveBayes(modelType="multinomial").fit(plain).transform(plain)
    assert [r["probability"] for r in a.collect()] == [r["probability"] for r in b.collect()]


def test_fits_at_once_keep_their_order_and_errors(spark):
    df = MD.assemble(spark.createDataFrame([(float(i), 2.0 * i + 1, float(-i)) for i in range(50)], "x double, label double, z double"), ["x"])
    names = ["linear_regression", "no_such_model", "decision_tree_regressor", "ridge_regression"]
    a, b = (MD.train_models(df, df, names, MD.REGRESSION, parallelism=p) for p in (1, 4))
    assert [(r.model_name, r.score) for r in a.results] == [(r.model_name, r.score) for r in b.results]
    assert "catalogue" in b.results[1].error and [r.model_name for r in b.results] == names
    late = MD.train_models(df, df, names, MD.REGRESSION, time_budget_s=-1.0)
    assert all(r.error.startswith("skipped") for r in late.results)
