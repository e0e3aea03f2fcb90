"""Driver contract: entry() runs; every oracle-backed query equals its DuckDB SQL
at sf0.001 (row count, column names, order-insensitive values)."""

import importlib

import duckdb
import pytest

from conftest import SF0001

E = importlib.import_module("__spark_entry__")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
HEAVY = {"model_ranking", "stacking_oof", "tfidf_logistic_scores", "gbt_scores", "isolation_scores"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "mean" in df.columns


def test_every_query_has_a_callable():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 60


def _norm(v):
    import math
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF0001).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    cols = sorted(got.columns)
    rows = lambda pdf: sorted("|".join(_norm(x) for x in r) for r in pdf[cols].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


# The training-data queries (opN_ and pipeline) have tests of their own.
@pytest.mark.parametrize("name", sorted(n for n in set(E.queries()) - set(E.oracle_sql())
                                        if n != "pipeline" and not n.startswith("op")))
def test_rows_only_query_runs(spark, name):
    df = E.queries()[name](spark, SF0001)
    assert df.count() > 0 and len(df.columns) > 0


def test_wide_rows_are_compiled(spark):
    """Methods too large for the JVM's compiler are split, also in a session of other settings."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    E.queries()["profile_missing"](spark, SF0001)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
