"""Ordered operators: distributed row index, halo-blocked windows, series profile."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import ordering as O
from quarry.operators import series as S


def _frame(spark, n=500):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i * 7 % 1000), float((i * 37) % 101))
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, ts timestamp, v double")


def test_row_index_range_path_equals_window(spark):
    df = _frame(spark)
    big = O.row_index(df, ["ts", "id"], rows_per_range=37)  # forces range partitions + checkpoint
    ref = df.withColumn("ref", F.row_number().over(Window.orderBy("ts", "id")) - 1)
    j = big.join(ref, "id")
    assert j.where(F.col("__idx") != F.col("ref")).count() == 0
    assert big.count() == 500


def test_row_index_partitioned(spark):
    df = _frame(spark).withColumn("g", (F.col("id") % 3).cast("int"))
    big = O.row_index(df, ["ts", "id"], partition_cols=["g"], rows_per_range=41)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("g").orderBy("ts", "id")) - 1)
    assert big.join(ref, ["id", "g"]).where(F.col("__idx") != F.col("ref")).count() == 0


def test_blocked_window_equals_plain_window(spark):
    df = O.row_index(_frame(spark), ["ts", "id"])
    v = F.col("v")
    blocked = O.blocked_window(df, O.IDX, 6, {
        "m": lambda w: O.rolling(w, v, 7, "mean"), "l": lambda w: F.lag(v, 3).over(w)}, block=10)
    w = Window.orderBy(O.IDX)
    plain = df.select("id", O.rolling(w, v, 7, "mean").alias("m0"), F.lag(v, 3).over(w).alias("l0"))
    j = blocked.join(plain, "id")
    assert j.count() == 500
    bad = j.where(~F.col("m").eqNullSafe(F.col("m0")) | ~F.col("l").eqNullSafe(F.col("l0")))
    # Means may differ only by rounding of the window sum order.
    assert bad.where(F.abs(F.col("m") - F.col("m0")) > 1e-9).count() == 0


def test_prefix_sums(spark):
    df = O.row_index(_frame(spark), ["id"])
    out = O.prefix_sums(df, O.IDX, ["v"], block=16).orderBy("id").toPandas()
    assert out["v_cum"].tolist() == pytest.approx(out["v"].cumsum().tolist())


def test_elapsed_days_floor(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23),), (dt.datetime(2024, 1, 3, 1),)], "ts timestamp")
    assert S.date_range(df, "ts").first()["duration_days"] == 1


def test_trend_and_stationarity_vs_numpy(spark):
    import numpy as np
    vals = [float(i) + (i % 5) for i in range(60)]
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(vals)]
    series = spark.createDataFrame(rows, "ts timestamp, value double")
    t = S.trend(series).first()
    assert t["slope"] == pytest.approx(np.polyfit(np.arange(60), vals, 1)[0])
    assert t["trend"] == "upward trend"
    st = S.stationarity(series).first()
    s = pd.Series(vals)
    a, b = s[:30].var(), s[30:].var()
    assert st["variance_ratio"] == pytest.approx(max(a, b) / (min(a, b) + 1e-10))


def test_frequency_daily(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i),) for i in range(20)]
    f = S.frequency(spark.createDataFrame(rows, "ts timestamp"), "ts").first()
    assert f["frequency"] == "daily" and f["step_seconds"] == 86400.0


def test_row_index_hot_group_large_path(spark):
    # One group holds a third of the rows; the range path must still index it exactly.
    rows = [(i, 0 if i % 3 == 0 else i % 7 + 1, float(i * 13 % 97)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g int, v double")
    big = O.row_index(df, ["v", "id"], partition_cols=["g"], rows_per_range=50)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")) - 1)
    assert big.join(ref, ["id", "g"]).where(F.col("__idx") != F.col("ref")).count() == 0
    # The hot group is spread over several ranges instead of one task.
    ranged = df.repartitionByRange(18, "g", "v", "id")
    per_task = ranged.where("g = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per_task) >= 5


def test_rolling_per_series_blocked(spark, monkeypatch):
    import numpy as np
    rows = []
    for g, n in (("a", 300), ("b", 40), ("c", 5)):   # one series dominates
        for i in range(n):
            rows.append((g, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float((i * 17 + len(g)) % 23)))
    df = spark.createDataFrame(rows, "g string, ts timestamp, value double")
    monkeypatch.setattr(O, "ROWS_PER_RANGE", 40)
    out = S.rolling_stats(df, window=5, block=16, series_cols=["g"]).toPandas()
    for g, part in out.groupby("g"):
        part = part.sort_values("idx")
        want = part["value"].rolling(5).mean().to_numpy()
        assert np.allclose(part["rolling_mean"].to_numpy(dtype=float), want, equal_nan=True)
        assert part["idx"].tolist() == list(range(len(part)))
