"""Profiling operators on hand-built edge frames (FIXTURES §C) and pandas cross-checks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import profile as P
from quarry.operators.quantiles import quantiles


def test_nan_and_null_are_both_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    m = P.missing_counts(df).first()
    assert m["n_missing"] == 2 and m["n_rows"] == 3
    d = P.describe(df).first()
    assert d["mean"] == 1.0 and d["count"] == 1


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double")
    r = P.correlations(df).first()
    assert r["correlation"] is None


def test_pairwise_missing_correlation_matches_pandas(spark):
    rows = [(1.0, 1.0), (2.0, 3.0), (None, 5.0), (3.0, 4.0), (5.0, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    r = P.correlations(df).first()["correlation"]
    expected = pd.DataFrame(rows, columns=["x", "y"]).corr().loc["x", "y"]
    assert r == pytest.approx(expected, rel=1e-12)
    assert r == pytest.approx(0.9819805060619657, rel=1e-9)


def test_quartiles_linear(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double")
    d = P.describe(df).first()
    assert (d["q25"], d["q50"], d["q75"]) == (1.75, 3.0, 5.0)


@pytest.mark.parametrize("method", ["brackets", "select"])
def test_quantile_methods_agree_with_numpy(spark, method):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=500), np.full(300, 2.5)])  # a hot value
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    q = quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.75, 0.99], method=method)["x"]
    assert q == pytest.approx(list(np.quantile(vals, [0.1, 0.25, 0.5, 0.75, 0.99])), rel=1e-12)


def test_quantile_select_uses_range_partitioned_index(spark, monkeypatch):
    from quarry.operators import ordering
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 50)
    vals = [float(i % 97) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    from quarry.operators import quantiles as Q
    monkeypatch.setattr(Q, "row_index", lambda d, o: ordering.row_index(d, o, rows_per_range=20))
    q = Q.select_quantiles(df, "x", [0.25, 0.5, 0.9])
    assert q == pytest.approx(list(np.quantile(vals, [0.25, 0.5, 0.9])))


def test_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "k int, v string")
    d = P.duplicate_counts(df).first()
    assert d["n_duplicates"] == 1 and d["n_rows"] == 3


def test_distinct_flags(spark):
    df = spark.createDataFrame([(i, "c", str(i % 2)) for i in range(10)], "id int, const string, half string")
    prof = {r["column"]: r for r in P.distinct_profile(df).collect()}
    assert prof["id"]["is_potential_id"] and not prof["id"]["is_constant"]
    assert prof["const"]["is_constant"]
    assert not prof["half"]["is_high_cardinality"]


def test_top_values_tie_break(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "v string")
    top = P.top_values(df, ["v"], 2).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in top] == [("a", 2), ("b", 2)]


def test_iqr_outliers_vs_pandas(spark):
    vals = [1.0, 2.0, 2.5, 3.0, 3.5, 4.0, 100.0, -50.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = P.iqr_outliers(df).first()
    s = pd.Series(vals)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert r["n_outliers"] == int(((s < lo) | (s > hi)).sum())
    assert r["lower_bound"] == pytest.approx(lo) and r["upper_bound"] == pytest.approx(hi)


def test_single_row_and_empty(spark):
    one = spark.createDataFrame([(1.0,)], "x double")
    assert P.describe(one).first()["std"] is None
    empty = spark.createDataFrame([], "x double")
    assert P.describe(empty).first()["count"] == 0
    assert P.duplicate_counts(empty).first()["n_rows"] == 0


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    h = P.histogram(df, "x", 30).where("count > 0").collect()
    assert len(h) == 1 and h[0]["bin"] == 0 and h[0]["count"] == 2


def test_target_profile_kind(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)], "y double")
    kind, _ = P.target_profile(df, "y")
    assert kind == "continuous"
    df2 = spark.createDataFrame([("a",), ("a",), ("a",), ("a",), ("b",)], "y string")
    kind2, prof = P.target_profile(df2, "y")
    assert kind2 == "categorical" and prof.first()["is_imbalanced"]


def test_correlations_are_pairwise_complete_at_any_width(spark):
    rng = np.random.default_rng(9)
    data = rng.normal(size=(400, 36)) + 1e6
    data[:, 3] = data[:, 0] * 2 + rng.normal(size=400) * 0.1
    data[:, 4] = 1.25  # constant column
    data[rng.random(data.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(36)]
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in data], ", ".join(f"{n} double" for n in names))
    got = {(r["feature1"], r["feature2"]): r["correlation"] for r in P.correlations(df.repartition(5)).collect()}
    assert len(got) == 36 * 35 // 2
    for i in range(36):
        for j in range(i + 1, 36):
            both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
            if 4 in (i, j):
                assert got[names[i], names[j]] is None
            else:
                want = np.corrcoef(data[both, i], data[both, j])[0, 1]
                assert got[names[i], names[j]] == pytest.approx(want, abs=1e-7)


def test_correlations_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (None, 3.0, 1.0)], "a double, b double, c double")
    assert {r["correlation"] for r in P.correlations(df).collect()} == {None}
    assert {r["correlation"] for r in P.correlations(df.limit(0)).collect()} <= {None}


@pytest.mark.parametrize("inside,accuracy", [(20000, 2000), (20, 100)])
def test_bracket_quantiles_narrow_down(spark, inside, accuracy):
    from quarry.operators.quantiles import bracket_quantiles
    rng = np.random.default_rng(5)
    vals = {"a": rng.normal(size=900), "b": np.concatenate([np.full(600, 7.0), rng.integers(0, 50, 300)]).astype(float),
            "c": np.where(rng.random(900) < 0.5, np.nan, rng.exponential(size=900)), "d": np.full(900, np.nan), "e": np.full(900, -1.5)}
    rows = [tuple(None if np.isnan(vals[k][i]) else float(vals[k][i]) for k in vals) for i in range(900)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in vals)).repartition(4)
    probs = [0.0, 0.25, 0.5, 0.999]
    got = bracket_quantiles(df, list(vals), probs, inside, accuracy)
    assert got.pop("d") == [None] * len(probs)
    for k, q in got.items():
        assert q == pytest.approx(list(np.quantile(vals[k][~np.isnan(vals[k])], probs)), rel=1e-12), k


def test_top_values_of_unique_long_texts_stay_bounded(spark):
    rows = [("x" * 40 + str(i),) for i in range(3000)] + [("y" * 50,), ("z" * 50,)] * 2 + [("b",)] * 2
    df = spark.createDataFrame(rows, "t string")
    assert [tuple(r) for r in P.top_values_hashed(df, "t", 2).collect()] == [("b", 2), ("y" * 50, 2)]
    got = P.top_values_hashed(df, "t", 5).collect()
    assert [tuple(r) for r in got] == [("b", 2), ("y" * 50, 2), ("z" * 50, 2), ("x" * 40 + "0", 1), ("x" * 40 + "1", 1)]


@pytest.mark.parametrize("method", ["hash", "direct"])
def test_duplicates_methods_agree(spark, method):
    rows = [(i % 7, None if i % 5 == 0 else str(i % 3), float(i % 2)) for i in range(300)]
    rows += [(None, "1", 1.0), (1, None, None), (None, "1", 1.0)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    import pandas as pd
    want = int(pd.DataFrame(rows, columns=list("abc")).duplicated().sum())
    assert P.duplicate_counts(df, method).first()["n_duplicates"] == want


def test_column_counts_exact(spark):
    rows = [(i % 4, None if i % 9 == 0 else "t" * (i % 13), f"u{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, c string")
    got = {r["column"]: (r["n_rows"], r["n_missing"], r["n_distinct"]) for r in P.column_counts(df).collect()}
    import pandas as pd
    pdf = pd.DataFrame(rows, columns=list("abc"))
    for col in "abc":
        assert got[col] == (500, int(pdf[col].isna().sum()), int(pdf[col].nunique()))


def test_column_counts_long_texts_with_copies(spark):
    texts = [("x" * 40 + str(i % 50)) for i in range(300)] + ["y" * 100] * 3 + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    r = P.column_counts(df).first()
    assert (r["n_rows"], r["n_missing"], r["n_distinct"]) == (304, 1, 51)


@pytest.mark.parametrize("case", ["unique", "copies", "mixed"])
def test_top_values_hashed_matches_brute_force(spark, case):
    from collections import Counter
    rng = np.random.default_rng({"unique": 1, "copies": 2, "mixed": 3}[case])
    base = ["L" * 40 + f"{i:04d}" for i in range(120)]
    if case == "unique":
        vals = base
    elif case == "copies":
        vals = [base[int(j)] for j in rng.integers(0, 30, 400)]
    else:
        vals = base[:60] + [base[int(j)] for j in rng.integers(0, 10, 50)] + ["s%d" % (j % 7) for j in range(40)]
    vals = vals + [None]
    df = spark.createDataFrame([(x,) for x in vals], "t string")
    got = [(r["value"], r["count"]) for r in P.top_values_hashed(df, "t", 5).collect()]
    cnt = Counter(x for x in vals if x is not None)
    want = sorted(cnt.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
    assert got == want


def test_categorical_summary_hashed_equals_plain(spark):
    rows = [("L" * 70 + str(i % 9), "s" + str(i % 4)) for i in range(200)] + [(None, None)]
    df = spark.createDataFrame(rows, "long string, short string")
    cols = ["column", "value", "count", "rank", "n_unique", "n_missing"]
    plain = sorted(tuple(r) for r in P.categorical_summary(df).select(*cols).collect())
    auto = sorted(tuple(r) for r in P.categorical_summary(df, hashed_cols="auto").select(*cols).collect())
    assert plain == auto
