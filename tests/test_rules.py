"""Role / modality / task rules, run-metrics queries, scoring validation."""

import datetime as dt

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from quarry.operators import models as MD
from quarry.operators import rules as R
from quarry.operators import runs as RU
from quarry.operators import scoring as SC


def test_task_type_rules(spark):
    df = spark.createDataFrame([(i % 2, float(i), str(i % 3), i % 7) for i in range(200)],
                               "b int, r double, s string, m int")
    got = {t: R.task_type(df, t).first()["task_type"] for t in ["b", "r", "s", "m"]}
    assert got == {"b": "binary_classification", "r": "regression",
                   "s": "multiclass_classification", "m": "multiclass_classification"}


def test_modality(spark):
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0)], "date timestamp, y double")
    assert R.detect_modality(ts) == "timeseries"
    nlp = spark.createDataFrame([("w " * 80, 1)], "text string, label int")
    assert R.detect_modality(nlp) == "nlp"
    tab = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert R.detect_modality(tab) == "tabular"


def test_risks_small_and_ids(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "id long, x double")
    codes = {r["code"] for r in R.risks(df).collect()}
    assert {"very_small_dataset", "potential_id_columns"} <= codes


def test_runs_queries(spark):
    rows = [("r1", "v1", "a", "completed", "acc", 0.5), ("r2", "v1", "b", "completed", "acc", 0.7),
            ("r3", "v1", "c", "failed", "acc", 0.9), ("r1", "v1", "a", "completed", "f1", 0.4),
            ("r4", "v2", "a", "running", "acc", None)]
    runs = spark.createDataFrame(rows, "run_id string, version string, model string, status string, "
                                       "metric string, value double")
    best = RU.best_runs(runs, "acc").collect()
    assert [(r["version"], r["run_id"]) for r in best] == [("v1", "r2")]
    assert RU.best_runs(runs, "acc", higher_is_better=False, per_version=False).first()["run_id"] == "r1"
    cmp = {r["run_id"]: r for r in RU.compare_runs(runs, ["acc", "f1"]).collect()}
    assert cmp["r2"]["f1"] is None and cmp["r1"]["f1"] == 0.4
    s = RU.runs_summary(runs).first()
    assert (s["total_runs"], s["completed"], s["failed"], s["running"]) == (4, 2, 1, 1)


def test_synthetic_ids_and_validation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 6.0)], "x double, label double")
    m = LinearRegression().fit(MD.assemble(df, ["x"]))
    test = MD.assemble(spark.createDataFrame([(5.0,), (4.0,)], "x double"), ["x"])
    sub = SC.score(m, test.drop("features").transform(lambda d: MD.assemble(d, ["x"])), "y")
    assert sorted(r["id"] for r in sub.collect()) == [0, 1]
    v = SC.validate(sub).first()
    assert v["is_valid"] and v["n_columns"] == 2
    bad = SC.validate(sub.withColumn("y", F.lit(None).cast("double"))).first()
    assert not bad["is_valid"] and "missing" in bad["issues"]
