from pyspark.sql import functions as F

from quarry.operators import models as MD
from quarry.operators import splits as SP


def test_folds_without_time_are_marked(spark):
    df = spark.range(30).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("label"))
    df = SP.kfold(MD.assemble(df, ["x"]), "id", 3)
    stats = MD.data_stats(df)

    def factory():
        return MD.make_estimator("linear_regression", MD.REGRESSION, stats)

    for budget, done in ((1e-9, 0), (None, 3)):
        fs, summary = MD.cross_validate(df, factory, "fold", MD.REGRESSION, k=3, time_budget_s=budget)
        rows = fs.orderBy("fold").collect()
        assert [r["fold"] for r in rows] == [0, 1, 2]
        assert [r["status"] for r in rows] == ["done"] * done + ["skipped"] * (3 - done)
        assert all((r["score"] is None) == (r["status"] == "skipped") for r in rows)
        assert summary.first()["n_folds"] == done
