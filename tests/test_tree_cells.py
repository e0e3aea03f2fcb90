"""Trees fitted on cells are MLlib's trees of the rows."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import models as MD
from quarry.operators import tree_cells as TC


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(4000).select("id", ((F.col("id") * 7919) % 40).cast("double").alias("a"), ((F.col("id") * 104729) % 613 / 7.0).alias("b"),
                                 F.when(F.col("id") % 3 == 0, 0.0).otherwise(1.0).alias("c"))
    y = F.col("a") * 3 + F.col("b") * (F.col("c") + 1) + (F.col("id") * 31) % 17
    return MD.assemble(x.withColumn("y", y).withColumn("k", (y % 50 > 20).cast("double")), ["a", "b", "c"])


@pytest.mark.parametrize("name,task,label,kw", [
    ("gradient_boosting_classifier", MD.CLASSIFICATION, "k", {"maxIter": 6}),
    ("decision_tree_classifier", MD.CLASSIFICATION, "k", {}),
    ("gbt_regressor", MD.REGRESSION, "y", {"maxIter": 6}),
    ("decision_tree_regressor", MD.REGRESSION, "y", {"maxDepth": 6})])
def test_same_as_rows(spark, rows, tmp_dir, name, task, label, kw):
    make = lambda: MD.make_estimator(name, task, MD.DataStats(4000), label_col=label, **kw)
    est = TC.on_cells(make())
    assert isinstance(est, TC.CellTrees)
    model = est.fit(rows)
    MD.save_model(model, f"{tmp_dir}/m")
    old = make().fit(rows).transform(rows).select("id", F.col("prediction").alias("p"))
    for m in (model, MD.load_model(f"{tmp_dir}/m")):
        new = m.transform(rows)
        off = new.join(old, "id").where(F.abs(F.col("prediction") - F.col("p")) > 1e-6).count()
        assert off == 0 and new.columns[:len(rows.columns)] == rows.columns


def test_fit_reads_cells(spark, rows, monkeypatch):
    """The boosting passes go over one row per cell, however often the rows are repeated."""
    seen, fit = [], MD.GBTRegressor.fit

    def counted(self, df, *args):
        seen.append((df.count(), df.agg(F.sum("weight")).first()[0]))
        return fit(self, df, *args)

    monkeypatch.setattr(MD.GBTRegressor, "fit", counted)
    some = rows.withColumn("label", F.col("y"))
    many = some.crossJoin(spark.range(2).select(F.col("id").alias("copy")))
    for df in (some, many):
        run = MD.train_models(df, some, ["gbt_regressor"], MD.REGRESSION, overrides={"gbt_regressor": {"maxIter": 2}})
        assert run.results[0].error is None
    assert seen[0][0] == seen[1][0] <= 4000 and [w for _, w in seen] == [4000.0, 8000.0]


def test_missing_label_still_fails(spark, rows):
    df = rows.withColumn("label", F.when(F.col("id") != 5, F.col("y")))
    run = MD.train_models(df, rows.withColumn("label", F.col("y")), ["decision_tree_regressor"], MD.REGRESSION)
    assert run.results[0].error is not None


def test_drawn_rows_stay_rows():
    stats = MD.DataStats(10)
    for est in (MD.make_estimator("random_forest_regressor", MD.REGRESSION, stats),
                MD.make_estimator("gbt_regressor", MD.REGRESSION, stats, subsamplingRate=0.5),
                MD.make_estimator("linear_regression", MD.REGRESSION, stats)):
        assert TC.on_cells(est) is est
