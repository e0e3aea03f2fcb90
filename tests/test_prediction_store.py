"""Stored predictions: results, refusals and the absence of shuffles on the key."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import metrics as M
from quarry.operators import prediction_store as PS
from quarry.plans import automl as A


@pytest.fixture
def store(spark, tmp_dir):
    return PS.PredictionStore(spark, f"{tmp_dir}/store", buckets=4)


def truth(spark, n=60):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 3).cast("double").alias("label"))


def fill(spark, store, version, wrong_every, score):
    rows = truth(spark).withColumn("prediction", F.when(F.col("k") % wrong_every == 0, (F.col("label") + 1) % 3).otherwise(F.col("label")))
    store.write_labels(version, rows, "k")
    store.write_predictions(version, "m", rows, "k")
    store.write_runs(version, "classification", [("m", "accuracy", score)])
    return rows


def exchanges(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]


def test_evaluate_version(spark, store):
    rows = fill(spark, store, "v1", 5, 0.8)
    found = PS.evaluate_version(store, "v1", k=3)
    want = M.classification_metrics(rows).first()
    assert found["metrics"].first() == want
    assert found["model"] == "m" and found["score"] == 0.8
    assert sum(r["count"] for r in found["confusion"].collect()) == 60
    errors = found["errors"].collect()
    assert [r["key"] for r in errors] == [0, 5, 10] and errors[0]["n_errors"] == 12
    assert "errors" not in PS.evaluate_version(store, "v1", mode="quick")
    assert "metrics" not in PS.evaluate_version(store, "v1", mode="failures_only")


def test_no_shuffle_on_the_key(spark, store):
    fill(spark, store, "v1", 5, 0.8)
    fill(spark, store, "v2", 7, 0.6)
    assert store.scored("v1", "m").count() == 60
    assert not exchanges(store.scored("v1", "m"))
    assert not exchanges(PS.ensemble_versions(store, ["v1", "v2"], "weighted"))


def test_reopened_in_another_handle_and_rewritten(spark, store):
    fill(spark, store, "v1", 5, 0.8)
    again = PS.PredictionStore(spark, store.path, key_type="string", buckets=99)  # the stored layout counts
    assert (again.key_type, again.buckets) == ("bigint", 4)
    assert again.scored("v1").count() == 60 and not exchanges(again.scored("v1"))
    other = truth(spark, 10).withColumn("prediction", F.lit(0.0))
    again.write_predictions("v1", "m", other, "k")  # replaces the model's rows
    again.write_predictions("v1", "n", other, "k")
    assert sorted((r["model"], r["count"]) for r in again.predicted("v1").groupBy("model").count().collect()) == [("m", 10), ("n", 10)]


def test_ensembles(spark, store):
    for version, value, score in (("v1", 1.0, 3.0), ("v2", 5.0, 1.0)):
        rows = truth(spark, 4).withColumn("prediction", F.lit(value))
        store.write_labels(version, rows, "k")
        store.write_predictions(version, "m", rows, "k")
        store.write_runs(version, "regression", [("m", "r2", score)])
    one = lambda *a, **k: {r["prediction"] for r in PS.ensemble_versions(store, ["v1", "v2"], *a, **k).collect()}
    assert one() == {3.0} and one("weighted") == {2.0} and one(weights=[0.0, 2.0]) == {5.0}
    for bad in (lambda: PS.ensemble_versions(store, ["v1"]), lambda: one(weights=[1.0]), lambda: one("no"), lambda: one(weights=[1.0, -1.0]),
                lambda: PS.ensemble_versions(store, ["v1", "missing"])):
        with pytest.raises(ValueError):
            bad()
    made = PS.store_ensemble(store, "v3", ["v1", "v2"])
    assert made["ensemble_version"] == "v3" and store.best("v3")["model"] == "ensemble"
    assert PS.evaluate_version(store, "v3")["metrics"].first()["n"] == 4


def test_keys_are_unique_and_present(spark, store):
    rows = truth(spark, 4)
    with pytest.raises(ValueError, match="more than one row"):
        store.write_labels("v", rows.unionByName(rows), "k")
    with pytest.raises(ValueError, match="without a key"):
        store.write_labels("v", rows.withColumn("k", F.lit(None).cast("bigint")).limit(1), "k")
    store.write_labels("empty", rows.limit(0), "k")
    assert store.truth("empty").count() == 0
    with pytest.raises(ValueError, match="has no model"):
        store.write_runs("v", "regression", [("m", "r2", 1.0)])
        PS.evaluate_version(store, "v", model="other")


def test_training_is_stored(spark, store):
    """auto_train writes labels, predictions, runs and its best model; all are found again."""
    df = spark.range(200).select(F.col("id").alias("key"), (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"),
                                 ((F.col("id") % 17) * 2.5 + F.col("id") % 5 + F.rand(3)).alias("target"))
    result = A.auto_train(df, "target", models=["linear_regression", "ridge_regression"], key="key", store=store, version="v1")
    assert {r["model"] for r in store.runs("v1").collect()} == {"linear_regression", "ridge_regression"}
    best = result.best()
    found = PS.evaluate_version(store, "v1")
    assert found["model"] == best.model_name
    assert found["metrics"].first()["r2"] == pytest.approx(best.score)
    model = store.load_best("v1")
    valid = best.predictions.select("features", F.col("prediction").alias("was"))
    assert model.transform(valid).where("abs(prediction - was) > 1e-12").count() == 0
