"""Stored models give the same predictions when another process loads them."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from quarry.operators import knn as KNN
from quarry.operators import models as MD
from quarry.operators import persistence as P

NAMES = [*MD.CATALOGUE]
FAST = {n: {"maxIter": 3} for n in ("gradient_boosting_classifier", "hist_gradient_boosting_classifier", "xgboost", "lightgbm",
                                    "catboost", "gbt_regressor", "logistic_regression")}
FAST |= {n: {"numTrees": 3, "maxDepth": 4} for n in ("random_forest_classifier", "random_forest_regressor")}
FAST |= {"isolation_forest": {"n_trees": 5, "max_samples": 16, "featureCols": ["x", "z"]}}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), float(abs(rng.normal())), f"g{i % 4}", float(i % 2),
             ("good fine words " if i % 2 else "bad poor terms ") + f"w{i % 7}") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, x double, z double, g string, label double, text string")
    return MD.assemble(df.withColumn("x", F.abs("x")), ["x", "z"]).cache()


def predictions(model, df, out="prediction"):
    return {r["id"]: r[out] for r in model.transform(df).select("id", out).collect()}


def fitted(name, data):
    task = MD.CATALOGUE[name][0][0]
    est = MD.make_estimator(name, task, MD.data_stats(data, "label", task), **FAST.get(name, {}))
    return est.fit(data)


def composed(data):
    stats = MD.data_stats(data)
    linear = lambda: MD.make_estimator("linear_regression", MD.REGRESSION, stats)
    tree = lambda: MD.make_estimator("decision_tree_classifier", MD.CLASSIFICATION, stats, maxDepth=3)
    from quarry.operators import splits as SP
    stacked, _ = MD.stacking_fit(SP.kfold(data, "id", 2), {"a/b": tree, "nb": lambda: MD.make_estimator("gaussian_nb", MD.CLASSIFICATION, stats)},
                                 LogisticRegression(), "fold", MD.CLASSIFICATION, "id", k=2)
    return {"group_mean": MD.GroupMeanRegressor(groupCol="g").fit(data),
            "hybrid": MD.hybrid_fit(data, linear(), MD.GroupMeanRegressor(groupCol="g")),
            "stacking": stacked,
            "pipeline": Pipeline(stages=[KNN.KNNEstimator(k=3)]).fit(data)}


@pytest.mark.parametrize("name", NAMES)
def test_every_catalogue_model_is_stored(data, tmp_dir, name):
    model = fitted(name, data)
    out = "anomaly_score" if name == "isolation_forest" else "prediction"
    MD.save_model(model, f"{tmp_dir}/m")
    again = MD.load_model(f"{tmp_dir}/m")
    assert type(again) is type(model)
    assert predictions(again, data, out) == predictions(model, data, out)


def test_composed_models_load_in_a_new_session(spark, data, tmp_dir):
    """Hybrid, stacking, group mean, kNN in a pipeline, isolation forest and a set of models."""
    models = composed(data)
    models["isolation_forest"] = fitted("isolation_forest", data)
    want = {}
    for name, model in models.items():
        MD.save_model(model, f"{tmp_dir}/{name}")
        out = "anomaly_score" if name == "isolation_forest" else "prediction"
        want[name] = {str(k): v for k, v in predictions(model, data, out).items()}
    averaged = {"lin": fitted("linear_regression", data), "tree": fitted("decision_tree_regressor", data)}
    MD.save_model(averaged, f"{tmp_dir}/set")
    want["set"] = {str(r["key"]): r["prediction"] for r in
                   MD.weighted_average_predict(averaged, data, "id", {"lin": 1.0, "tree": 3.0}).collect()}
    data.write.parquet(f"{tmp_dir}/data")
    code = f"""
import json
from quarry.session import get_spark
from quarry.operators import models as MD
spark = get_spark("local[2]", 2, app_name="load", extra={{"spark.driver.memory": "2g"}})
data = spark.read.parquet("{tmp_dir}/data")
out = {{}}
for name in {[*models]!r}:
    col = "anomaly_score" if name == "isolation_forest" else "prediction"
    out[name] = {{str(r["id"]): r[col] for r in MD.load_model("{tmp_dir}/" + name).transform(data).select("id", col).collect()}}
loaded = MD.load_model("{tmp_dir}/set")
out["set"] = {{str(r["key"]): r["prediction"] for r in
              MD.weighted_average_predict(loaded, data, "id", {{"lin": 1.0, "tree": 3.0}}).collect()}}
print("RESULT" + json.dumps(out))
"""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, text=True, timeout=300,
                          env={**os.environ, "PYTHONPATH": repo})
    line = [x for x in done.stdout.splitlines() if x.startswith("RESULT")]
    assert line, done.stderr[-2000:]
    assert json.loads(line[0][6:]) == want


def test_python_stage_inside_a_pipeline(data, tmp_dir):
    model = composed(data)["pipeline"]
    MD.save_model(model, f"{tmp_dir}/p")
    assert predictions(PipelineModel.load(f"{tmp_dir}/p"), data) == predictions(model, data)


def test_a_loaded_model_is_not_overwritten_by_itself(data, tmp_dir):
    MD.save_model(MD.GroupMeanRegressor(groupCol="g").fit(data), f"{tmp_dir}/m")
    again = MD.load_model(f"{tmp_dir}/m")
    with pytest.raises(ValueError, match="overwritten by itself"):
        MD.save_model(again, f"{tmp_dir}/m")
    MD.save_model(again, f"{tmp_dir}/other")
    assert predictions(MD.load_model(f"{tmp_dir}/other"), data) == predictions(again, data)
    assert P.class_of(f"{tmp_dir}/m").endswith("GroupMeanModel")
