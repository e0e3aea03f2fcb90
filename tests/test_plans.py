"""Composed plans: report frame, automatic training, benchmark, streaming scoring."""

import os

from pyspark.sql import functions as F

from conftest import SF0001
from quarry.operators import models as MD
from quarry.plans import automl as A
from quarry.plans import report as RP
from quarry.sources.scan import read_table

SMALL = {"random_forest_classifier": {"numTrees": 5, "maxDepth": 4},
         "gradient_boosting_classifier": {"maxIter": 5, "maxDepth": 3},
         "decision_tree_classifier": {"maxDepth": 4},
         "random_forest_regressor": {"numTrees": 5, "maxDepth": 4},
         "gbt_regressor": {"maxIter": 5, "maxDepth": 3},
         "decision_tree_regressor": {"maxDepth": 4}}


def test_reports_by_modality(spark):
    orders = read_table(spark, SF0001, "orders")
    rep = RP.eda_report(orders)
    sections = {r["section"] for r in rep.select("section").distinct().collect()}
    assert {"basic_stats", "numeric", "categorical", "recommendations"} <= sections
    daily = orders.groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("value"))
    ts = RP.eda_report(daily, "timeseries")
    assert ts.where("section = 'frequency' AND metric = 'frequency'").first()["value"] == "daily"
    docs = read_table(spark, SF0001, "documents")
    assert RP.eda_report(docs, "nlp").where("section = 'vocabulary'").count() == 2


def test_auto_train_classification_and_submission(spark, tmp_dir):
    orders = read_table(spark, SF0001, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority",
                                                        "o_orderstatus")
    res = A.auto_train(orders.drop("o_orderkey"), target="o_orderstatus", overrides=SMALL)
    assert res.task == MD.CLASSIFICATION and res.run.rankings(spark).count() >= 3
    test = orders.drop("o_orderstatus").withColumnRenamed("o_orderkey", "id")
    sub, report = A.submission(res, test, "id", out_path=os.path.join(tmp_dir, "sub"))
    r = report.first()
    assert r["is_valid"] and r["n_rows"] == orders.count()
    assert set(x["o_orderstatus"] for x in sub.select("o_orderstatus").distinct().collect()) <= {"F", "O", "P"}


def test_benchmark_regression(spark):
    li = read_table(spark, SF0001, "lineitem").select("l_quantity", "l_discount", "l_returnflag",
                                                      "l_extendedprice")
    res = A.benchmark(li, target="l_extendedprice", overrides=SMALL)
    assert res.task == MD.REGRESSION
    assert res.run.rankings(spark).count() == 4


def test_streaming_scoring_equals_batch(spark, tmp_dir):
    orders = read_table(spark, SF0001, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority",
                                                        "o_orderstatus")
    res = A.auto_train(orders.drop("o_orderkey"), target="o_orderstatus",
                       models=["logistic_regression"])
    src = os.path.join(tmp_dir, "in")
    test = orders.drop("o_orderstatus").withColumnRenamed("o_orderkey", "id")
    test.write.parquet(src)
    from quarry.streaming.scoring import score_stream
    stream = spark.readStream.schema(test.schema).parquet(src)
    scored = score_stream(stream, res.features, res.best().model, res.feature_cols, "id",
                          "o_orderstatus", labels=res.labels)
    q = scored.writeStream.format("memory").queryName("scored_orders").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("scored_orders")
    batch, _ = A.submission(res, test, "id")
    assert got.count() == test.count()
    assert got.exceptAll(batch).count() == 0


def test_strategy_report(spark):
    nation = read_table(spark, SF0001, "nation")
    rep = RP.strategy_report(nation)
    rows = {(r["section"], r["subject"], r["metric"]): r["value"] for r in rep.collect()}
    assert rows[("summary", None, "n_samples")] == "25"
    assert ("risks", "very_small_dataset", "detail") in rows
