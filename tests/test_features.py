"""Feature fit / transform edge cases (FIXTURES §C) and persistence."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import features as FE


def test_label_codes_missing_shift(spark):
    # classes sorted: 'B', '__MISSING__', 'a' -> codes 0, 1, 2; NULL imputed with the mode 'a'.
    df = spark.createDataFrame([(0, "B"), (1, "a"), (2, None), (3, "a")], "k int, c string")
    m = FE.fit(df, strategy="basic", exclude=("k",))
    out = {r["k"]: r["c"] for r in m.transform(df, keep=("k",)).collect()}
    assert out == {0: 0, 1: 2, 2: 2, 3: 2}
    unseen = spark.createDataFrame([(9, "zzz")], "k int, c string")
    assert m.transform(unseen, keep=("k",)).first()["c"] == -1


def test_mode_tie_is_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert FE.fit_modes(df, ["c"])["c"] == "a"


def test_category_codes(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a")], "k int, c string")
    out = {r["k"]: r["c"] for r in FE.category_codes(df, ["c"]).collect()}
    assert out == {0: 1, 1: -1, 2: 0}


def test_target_encoding(spark):
    df = spark.createDataFrame([("0", 1.0), ("0", 2.0), ("1", 9.0)], "k string, y double")
    m = FE.fit(df, target="y", strategy="target_encoding")
    assert [r["k"] for r in m.transform(df).collect()] == [1.5, 1.5, 9.0]
    unseen = spark.createDataFrame([("7", 0.0)], "k string, y double")
    assert m.transform(unseen).first()["k"] == pytest.approx(4.0)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    m = FE.fit(df)
    assert [r["x"] for r in m.transform(df).collect()] == [0.0, 0.0]


def test_scaling_is_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    vals = [r["x"] for r in FE.fit(df).transform(df).collect()]
    import numpy as np
    a = np.array([1.0, 2.0, 4.0])
    assert vals == pytest.approx(list((a - a.mean()) / a.std()))


def test_interactions_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0)], "a double, b double, c double, d double, e double")
    out = FE.fit(df, strategy="advanced").transform(df)
    assert [c for c in out.columns if c.endswith("_mul")] == ["a_b_mul", "a_c_mul", "a_d_mul",
                                                            "b_c_mul", "b_d_mul", "c_d_mul"]


def test_one_hot_refuses_high_cardinality(spark):
    df = spark.createDataFrame([(str(i),) for i in range(20)], "c string")
    with pytest.raises(ValueError):
        FE.one_hot(df, ["c"], max_categories=10)


def test_polynomial_degree2(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    r = FE.polynomial(df, ["a", "b"], 2).first().asDict()
    assert r == {"a": 2.0, "b": 3.0, "a_x_a": 4.0, "a_x_b": 6.0, "b_x_b": 9.0}


def test_save_and_load_restore_fitted_state(spark, tmp_dir):
    df = spark.createDataFrame([(1.0, "x"), (3.0, "y"), (None, "x")], "n double, c string")
    m = FE.fit(df)
    m.save(tmp_dir + "/fm")
    m2 = FE.FeatureModel.load(spark, tmp_dir + "/fm")
    a = sorted(tuple(r) for r in m.transform(df).collect())
    b = sorted(tuple(r) for r in m2.transform(df).collect())
    assert a == b


def test_large_code_table_is_not_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    table = FE.fit_label_codes(df, "c")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    small = FE.join_code(df, F.col("c"), table, "code", "out", -1)
    assert "strategy=broadcast" in plan(small) and small.where("out < 0").count() == 0
    monkeypatch.setattr(FE, "BROADCAST_BYTES", 10)
    large = FE.join_code(df, F.col("c"), table, "code", "out", -1)
    assert "strategy=broadcast" not in plan(large) and large.where("out < 0").count() == 0


def test_save_twice_replaces(spark, tmp_dir):
    df = spark.createDataFrame([(1.0, "x"), (3.0, "y"), (None, "x")], "n double, c string")
    for strategy in ("basic", "target_encoding"):
        m = FE.fit(df, target="n" if strategy == "target_encoding" else None, strategy=strategy)
        for _ in range(2):
            m.save(tmp_dir + "/twice", mode="overwrite")
        again = FE.FeatureModel.load(spark, tmp_dir + "/twice")
        assert sorted(again.transform(df).collect()) == sorted(m.transform(df).collect())
        assert again.transform(df).count() == 3


def test_one_hot_names_do_not_collide(spark, tmp_dir):
    df = spark.createDataFrame([("a-b",), ("a_b",), ("A b",)] + [(str(i),) for i in range(120)], "c string")
    out = FE.one_hot(df, ["c"])
    assert len({x.lower() for x in out.columns}) == len(out.columns) == 123
    out.write.parquet(tmp_dir + "/onehot")
