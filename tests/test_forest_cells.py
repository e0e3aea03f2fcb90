"""Forests fitted on drawn cells are forests of the drawn rows."""

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from conftest import SF0001
from quarry import session
from quarry.operators import forest_cells as FC
from quarry.operators import models as MD
from quarry.operators import tree_cells as TC
from quarry.plans import model_queries as Q


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(4000).select("id", ((F.col("id") * 7919) % 20).cast("double").alias("a"), ((F.col("id") * 104729) % 3).cast("double").alias("b"),
                                 F.when(F.col("id") % 7 < 6, 0.0).otherwise(1.0).alias("c"))
    y = F.col("a") * 3 + F.col("b") * (F.col("c") + 1) + (F.col("id") * 31) % 17
    return MD.assemble(x.withColumn("label", y), ["a", "b", "c"]).cache()


def forest(**kw):
    return MD.make_estimator("random_forest_regressor", MD.REGRESSION, MD.DataStats(4000), **kw)


def test_copies_are_poisson():
    shares, table = FC.copies_table()
    k = FC.copies(np.random.default_rng(1), 400_000, shares, table)
    got, want = np.bincount(k, minlength=6)[:6] / len(k), np.diff(shares, prepend=0.0)[:6]
    assert np.abs(got - want).max() < 0.004 and (k >= 0).all() and abs(k.var() - 1) < 0.02
    # Where 16 bits leave two numbers open, both come, and no others do.
    u = int(np.flatnonzero(table < 0)[0])

    class Fixed:
        integers = staticmethod(lambda low, high, n, dtype: np.full(n, u, dtype))
        random = staticmethod(lambda n: np.linspace(0, 1, n, endpoint=False))
    assert len(set(FC.copies(Fixed, 1000, shares, table).tolist())) == 2


def test_sums_over_borders():
    rng = np.random.default_rng(2)
    code, y = np.sort(rng.integers(0, 6, 100)), rng.random(100)
    k = rng.integers(0, 3, (100, 4)).astype(np.int8)
    left = [k[:0]]

    def draw(n):
        at = sum(len(x) for x in left)
        left.append(k[at:at + n])
        return left[-1]

    parts = list(FC.cell_sums(code, y, draw, together=7))
    codes, w, s = (np.concatenate(x) for x in zip(*parts))
    assert codes.tolist() == sorted(set(code.tolist()))
    for i, x in enumerate(codes):
        assert (w[i] == k[code == x].sum(0)).all() and np.allclose(s[i], (k * y[:, None])[code == x].sum(0))


@pytest.mark.parametrize("rows_a_task", [100_000, 300])
def test_drawn_cells(spark, rows, rows_a_task):
    """All rows are drawn from, also those of a cell that several tasks share."""
    df = rows.withColumn("label", F.col("label") * 0 + F.col("a")).unionByName(rows.where("id = 5").withColumn("label", F.col("a")).crossJoin(spark.range(2000).toDF("copy")).select(*rows.columns))
    est = forest()
    cells = TC.make_cells(est, df)
    drawn = FC.drawn_cells(df, cells, "features", "label", 60, 42, rows_a_task)
    by_tree = drawn.groupBy("tree").agg(F.sum("weight").alias("w")).collect()
    assert len(by_tree) == 60 and all(abs(r["w"] - 6000) < 6 * 6000 ** 0.5 for r in by_tree)
    by_cell = drawn.groupBy("features").agg(F.sum("weight").alias("w"), F.min("label").alias("low"), F.max("label").alias("high")).collect()
    truth = {r["features"]: r["weight"] for r in cells.frame().collect()}
    assert {r["features"] for r in by_cell} == set(truth)
    assert all(abs(r["w"] - 60 * truth[r["features"]]) < 6 * (60 * truth[r["features"]]) ** 0.5 and abs(r["low"] - r["high"]) < 1e-9 for r in by_cell)
    again = FC.drawn_cells(df.repartition(5), cells, "features", "label", 60, 42, 100_000)
    if rows_a_task == 100_000:  # the same draws in whatever order the rows come
        plain = lambda x: sorted((r["tree"], str(r["features"]), r["label"], r["weight"]) for r in x.collect())
        assert plain(again) == plain(drawn)


def test_same_tree_as_drawn_rows(spark, rows, monkeypatch):
    """A tree of the cells is MLlib's tree of the rows with their copies as weights."""
    monkeypatch.setattr(FC, "copies", lambda rng, n, shares, table: np.full(n, 2, np.int8))
    cells = TC.make_cells(forest(), rows)
    drawn = FC.drawn_cells(rows, cells, "features", "label", 1, 42)
    one = dict(numTrees=1, bootstrap=False, featureSubsetStrategy="2", seed=7, maxDepth=6, weightCol="weight")
    a = FC.CellForestModel(cells.cuts, "features", RandomForestRegressor(**one).fit(drawn).setFeaturesCol("__vector")).transform(rows)
    b = RandomForestRegressor(**one).fit(rows.withColumn("weight", F.lit(2.0))).transform(rows)
    off = a.select("id", "prediction").join(b.select("id", F.col("prediction").alias("p")), "id").where(F.abs(F.col("prediction") - F.col("p")) > 1e-6)
    assert off.count() == 0


def test_forest_fit_reads_cells(spark, rows, tmp_dir, monkeypatch):
    """No tree's fit reads the rows, and the forest is as good as that of the rows."""
    seen, fit = [], RandomForestRegressor.fit

    def counted(self, df, *args):
        seen.append(df.count())
        return fit(self, df, *args)

    kw = {"maxDepth": 6, "numTrees": 20, "featureSubsetStrategy": "all"}  # else the drawn features decide the score
    old = forest(**kw).fit(rows)
    monkeypatch.setattr(RandomForestRegressor, "fit", counted)
    run = MD.train_models(rows, rows, ["random_forest_regressor"], MD.REGRESSION, overrides={"random_forest_regressor": kw})
    assert run.results[0].error is None
    assert len(seen) == 20 and max(seen) <= 20 * 3 * 2
    model = run.results[0].model
    assert model.inner.getNumTrees == 20 and model.inner.numFeatures == 3 and model.inner.totalNumNodes > 20 * 15
    assert abs(run.results[0].score - MD.score_predictions(old.transform(rows), MD.REGRESSION, "r2")) < 0.002
    MD.save_model(model, f"{tmp_dir}/m")
    looked = model.transform(rows)
    assert looked.columns == [*rows.columns, "prediction"] and looked.count() == 4000
    monkeypatch.setattr(FC, "LOOKED_UP", 0)  # row by row
    for m in (model, MD.load_model(f"{tmp_dir}/m")):
        off = looked.select("id", "prediction").join(m.transform(rows).select("id", F.col("prediction").alias("p")), "id")
        assert off.where(F.abs(F.col("prediction") - F.col("p")) > 1e-9).count() == 0


def test_others_stay_rows(spark, rows):
    """Few rows a cell, missing labels and forests that draw in other ways are MLlib's matter."""
    few = FC.forest_on_cells(forest(numTrees=3, maxDepth=2)).fit(rows.where("id < 200"))
    assert not isinstance(few, TC.CellTreesModel)
    missing = rows.withColumn("label", F.when(F.col("id") != 5, F.col("label")))
    run = MD.train_models(missing, rows, ["random_forest_regressor"], MD.REGRESSION, overrides={"random_forest_regressor": {"numTrees": 2}})
    assert run.results[0].error is not None
    for est in (forest(subsamplingRate=0.5), forest(bootstrap=False), forest(minInstancesPerNode=2), MD.make_estimator("random_forest_classifier", MD.CLASSIFICATION, MD.DataStats(9))):
        assert FC.forest_on_cells(est) is est


def test_cells_are_made_once(spark, rows, monkeypatch):
    made, make = [], TC.make_cells

    def counted(est, df):
        made.append(type(est).__name__)
        return make(est, df)

    monkeypatch.setattr(TC, "make_cells", counted)
    names = ["decision_tree_regressor", "random_forest_regressor", "gbt_regressor"]
    run = MD.train_models(rows, rows, names, MD.REGRESSION, overrides={
        "decision_tree_regressor": {"maxDepth": 2}, "random_forest_regressor": {"numTrees": 2, "maxDepth": 2}, "gbt_regressor": {"maxIter": 1}})
    assert [r.error for r in run.results] == [None] * 3 and len(made) == 1


def test_ranking_reads_stored_rows(spark, monkeypatch):
    """The features and the split are made once, and what is stored goes when the query ends."""
    seen = []

    def train(train, valid, names, task, **kw):
        seen.extend([*train.inputFiles(), *valid.inputFiles()])
        n = [train.count(), valid.count(), spark.read.parquet(f"{SF0001}/lineitem.parquet").count()]
        assert n[0] + n[1] == n[2] and 0 < n[1] < n[0]
        return MD.MultiModelRun([MD.TrainResult("m", 1.0, "r2", 0.0)])

    monkeypatch.setattr(Q.MD, "train_models", train)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    assert Q.model_ranking(spark, SF0001).count() == 1
    assert seen and all("/model-ranking-" in x for x in seen)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    import os
    assert not any(os.path.exists(x.removeprefix("file://").removeprefix("file:")) for x in seen)


def test_stored_rows_of_no_rows(spark):
    df = spark.createDataFrame([], "x double, part string")
    with session.stored_rows(df, "none", "part", writers=2) as kept:
        assert kept.where("part = 'a'").count() == 0 and set(kept.columns) == {"x", "part"}
