"""Contract queries for role / modality / task inference and rule reports
(V2, V4, V6-V9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ID_NAMES, TARGET_NAMES, TEXT_NAMES, TIME_NAMES
from ..operators import rules as R
from ..sources.scan import DIRTY_EVENTS_NORM_SQL, dirty_events, read_table
from .common import lit, q, union_all
from .profile_queries import _quality_sql
from .registry import register

# Fixed facts of the test tables (schema only): column, Spark type, type class.
SCHEMAS = {
    "orders": [("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
               ("o_orderstatus", "string", "categorical"), ("o_totalprice", "double", "numeric"),
               ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "categorical")],
    "documents": [("doc_id", "bigint", "numeric"), ("text", "string", "categorical"),
                  ("lang", "string", "categorical"), ("source", "string", "categorical"),
                  ("n_chars", "bigint", "numeric")],
    "conversations": [("conv_id", "bigint", "numeric"), ("turn", "bigint", "numeric"),
                      ("role", "string", "categorical"), ("text", "string", "categorical")],
    "events": [("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "datetime"),
               ("user_id", "bigint", "numeric"), ("event_type", "string", "categorical"),
               ("value", "double", "numeric"), ("props", "string", "categorical")],
    "lineitem": [("l_orderkey", "bigint", "numeric"), ("l_partkey", "bigint", "numeric"),
                 ("l_suppkey", "bigint", "numeric"), ("l_linenumber", "int", "numeric"),
                 ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
                 ("l_discount", "double", "numeric"), ("l_tax", "double", "numeric"),
                 ("l_returnflag", "string", "categorical"), ("l_linestatus", "string", "categorical"),
                 ("l_shipdate", "timestamp_ntz", "datetime")],
    "supplier": [("s_suppkey", "bigint", "numeric"), ("s_name", "string", "categorical"),
                 ("s_nationkey", "int", "numeric"), ("s_acctbal", "double", "numeric")],
    "nation": [("n_nationkey", "int", "numeric"), ("n_name", "string", "categorical"),
               ("n_regionkey", "int", "numeric")],
    "embeddings": [("vec_id", "bigint", "numeric"), ("embedding", "array<float>", "other"),
                   ("label", "int", "numeric")],
    "part": [("p_partkey", "bigint", "numeric"), ("p_name", "string", "categorical"),
             ("p_brand", "string", "categorical"), ("p_type", "string", "categorical"),
             ("p_size", "int", "numeric"), ("p_retailprice", "double", "numeric"),
             ("p_constant", "string", "categorical")],
}
SOURCES = {"part": "(SELECT *, 'x' AS p_constant FROM part)", "dirty_events": DIRTY_EVENTS_NORM_SQL}


def _load(spark, sf, name):
    if name == "dirty_events":
        return dirty_events(spark, sf)
    df = read_table(spark, sf, name)
    if name == "part":
        df = df.withColumn("p_constant", F.lit("x"))
    return df


def _schema(name):
    return SCHEMAS["events" if name == "dirty_events" else name]


def _src(name):
    return SOURCES.get(name, name)


def _in(names):
    return "(" + ", ".join(lit(n) for n in names) + ")"


def _roles_sql(table: str) -> str:
    parts = []
    for i, (col, dtype, kind) in enumerate(_schema(table)):
        avg = f"avg(length({q(col)}))" if kind == "categorical" else "avg(CAST(NULL AS DOUBLE))"
        parts.append(
            f"SELECT {lit(table)} AS table_name, {lit(col)} AS column_name, {i} AS ordinal, "
            f"{lit(dtype)} AS data_type, {lit(kind)} AS type_class, "
            f"lower({lit(col)}) IN {_in(TIME_NAMES)} AS is_time_name, "
            f"lower({lit(col)}) IN {_in(TEXT_NAMES)} AS is_text_name, "
            f"lower({lit(col)}) IN {_in([t.lower() for t in TARGET_NAMES])} AS is_target_name, "
            f"{lit(col)} IN {_in(ID_NAMES)} AS is_id_name, CAST({avg} AS DOUBLE) AS avg_length "
            f"FROM {_src(table)}")
    return union_all(parts)


ROLE_TABLES = ["orders", "documents", "conversations", "events"]


@register("infer_roles", f"""
SELECT table_name, column_name, data_type, type_class, is_time_name, is_text_name, is_target_name,
       is_id_name, round(avg_length, 6) AS avg_length
FROM ({union_all([_roles_sql(t) for t in ROLE_TABLES])})""")
def infer_roles(spark, sf):
    out = None
    for t in ROLE_TABLES:
        part = (R.column_roles(read_table(spark, sf, t)).drop("ordinal")
                .select(F.lit(t).alias("table_name"), "*")
                .withColumn("avg_length", F.round("avg_length", 6)))
        out = part if out is None else out.unionByName(part)
    return out


TASK_PAIRS = [("orders", "o_orderstatus"), ("orders", "o_totalprice"), ("labels", "quality"),
              ("embeddings", "label"), ("lineitem", "l_quantity"), ("customer", "c_mktsegment")]
NUMERIC_TARGET = {("orders", "o_orderstatus"): False, ("orders", "o_totalprice"): True,
                  ("labels", "quality"): True, ("embeddings", "label"): True,
                  ("lineitem", "l_quantity"): True, ("customer", "c_mktsegment"): False}


def _task_sql(table, target, numeric):
    k, n = "count(DISTINCT {0})".format(q(target)), "count(*)"
    if numeric:
        t = (f"CASE WHEN {k} <= 10 THEN CASE WHEN {k} = 2 THEN 'binary_classification' "
             f"ELSE 'multiclass_classification' END WHEN {k} * 1.0 / {n} < 0.05 "
             f"THEN 'multiclass_classification' ELSE 'regression' END")
    else:
        t = f"CASE WHEN {k} = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END"
    return (f"SELECT {lit(table)} AS table_name, {lit(target)} AS target, {n} AS n_rows, "
            f"{k} AS n_distinct, {str(numeric).upper()} AS is_numeric, {t} AS task_type FROM {_src(table)}")


@register("detect_task_type", union_all([_task_sql(t, c, NUMERIC_TARGET[(t, c)]) for t, c in TASK_PAIRS]))
def detect_task_type(spark, sf):
    out = None
    for t, col in TASK_PAIRS:
        part = R.task_type(read_table(spark, sf, t), col).select(F.lit(t).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


# Expected guessed targets: a known target name, else the last column.
SUMMARY_TABLES = {"orders": "o_orderpriority", "lineitem": "l_shipdate", "events": "props",
                  "documents": "n_chars", "supplier": "s_acctbal", "nation": "n_regionkey",
                  "embeddings": "label"}


def _summary_sql(table, target):
    cols = _schema(table)
    kinds = [k for _, _, k in cols]
    numeric = dict((c_, k) for c_, _, k in cols)[target] in ("numeric",)
    task = _task_sql(table, target, numeric)
    roles = _roles_sql(table)
    return f"""
SELECT {lit(table)} AS table_name,
       (SELECT CASE WHEN bool_or(is_time_name) AND count(*) <= 10 THEN 'timeseries'
                    WHEN bool_or(is_text_name AND type_class = 'categorical' AND avg_length > 100) THEN 'nlp'
                    ELSE 'tabular' END FROM ({roles})) AS modality,
       t.task_type, t.n_rows AS n_samples, {len(cols) - 1} AS n_features, {lit(target)} AS target_column,
       {kinds.count('numeric')} AS numeric_features, {kinds.count('categorical')} AS categorical_features,
       {kinds.count('datetime')} AS datetime_features
FROM ({task}) t"""


@register("dataset_summary", union_all([_summary_sql(t, c) for t, c in SUMMARY_TABLES.items()]))
def dataset_summary(spark, sf):
    out = None
    for t in SUMMARY_TABLES:
        part = R.dataset_summary(read_table(spark, sf, t)).select(F.lit(t).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


RISK_TABLES = ["supplier", "nation", "part", "dirty_events"]


def _quality_cte(table):
    kinds = {c_: k for c_, _, k in _schema(table)}
    return _quality_sql(_src(table), [c_ for c_, _, _ in _schema(table)], kinds)


def _risk_sql(table):
    ncols = len(_schema(table))
    return f"""
SELECT {lit(table)} AS table_name, code, detail FROM (
  SELECT 'very_small_dataset' AS code, n_rows || ' rows: fewer than 100, models overfit easily' AS detail
    FROM qr WHERE n_rows < 100
  UNION ALL SELECT 'small_dataset', n_rows || ' rows: fewer than 1000, prefer simple models'
    FROM qr WHERE n_rows >= 100 AND n_rows < 1000
  UNION ALL SELECT 'more_features_than_samples', {ncols - 1} || ' features for ' || n_rows || ' rows'
    FROM qr WHERE {ncols - 1} > n_rows
  UNION ALL SELECT 'high_missing', CAST(round(missing_cell_pct, 2) AS VARCHAR) || ' % of cells missing' FROM qr WHERE missing_cell_pct > 30
  UNION ALL SELECT 'moderate_missing', CAST(round(missing_cell_pct, 2) AS VARCHAR) || ' % of cells missing' FROM qr
    WHERE missing_cell_pct > 10 AND missing_cell_pct <= 30
  UNION ALL SELECT 'constant_features', constant_features FROM qr WHERE constant_features <> ''
  UNION ALL SELECT 'potential_id_columns', potential_id_columns FROM qr WHERE potential_id_columns <> ''
) r, (SELECT 1) one"""


def _with_qr(table, body):
    return f"(WITH qr AS ({_quality_cte(table)}) {body})"


@register("risks", union_all([f"SELECT * FROM {_with_qr(t, _risk_sql(t))}" for t in RISK_TABLES]))
def risks(spark, sf):
    out = None
    for t in RISK_TABLES:
        part = R.risks(_load(spark, sf, t)).select(F.lit(t).alias("table_name"), "code", "detail")
        out = part if out is None else out.unionByName(part)
    return out


FLAG_TABLES = {"dirty_events": "props", "orders": "o_orderpriority", "supplier": "s_acctbal"}


def _flags_sql(table, target):
    cols = _schema(table)
    kinds = [k for _, _, k in cols]
    numeric = dict((c_, k) for c_, _, k in cols)[target] == "numeric"
    task = _task_sql(table, target, numeric)
    return f"""
SELECT {lit(table)} AS table_name, code, detail FROM (
  SELECT 'impute_missing' AS code, columns_with_missing AS detail FROM qr WHERE columns_with_missing <> ''
  UNION ALL SELECT 'drop_constant', constant_features FROM qr WHERE constant_features <> ''
  UNION ALL SELECT 'drop_id_columns', potential_id_columns FROM qr WHERE potential_id_columns <> ''
  UNION ALL SELECT 'drop_duplicates', CAST(n_duplicates AS VARCHAR) FROM qr WHERE n_duplicates > 0
  UNION ALL SELECT 'encode_categorical', '{kinds.count('categorical')}' WHERE {kinds.count('categorical')} > 0
  UNION ALL SELECT 'scale_numeric', '{kinds.count('numeric')}' WHERE {kinds.count('numeric')} > 0
  UNION ALL SELECT 'check_class_balance', {lit(target)} FROM ({task}) t
    WHERE t.task_type LIKE '%classification%'
) r"""


@register("preprocessing_flags",
          union_all([f"SELECT * FROM {_with_qr(t, _flags_sql(t, tg))}" for t, tg in FLAG_TABLES.items()]))
def preprocessing_flags(spark, sf):
    out = None
    for t in FLAG_TABLES:
        part = R.preprocessing_steps(_load(spark, sf, t)).select(F.lit(t).alias("table_name"), "code", "detail")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- eda_flags (V6)
EDA_TABLES = {"dirty_events": "props", "orders": "o_orderpriority"}


def _outlier_cols_sql(table):
    parts = []
    for i, (col, _, kind) in enumerate(_schema(table)):
        if kind != "numeric":
            continue
        x = f"CAST({q(col)} AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS ordinal, {lit(col)} AS column_name, count(*) FILTER (WHERE {x} < b.lo OR {x} > b.hi) AS k "
            f"FROM {_src(table)}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
            f"(SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {_src(table)})) b")
    return f"(SELECT string_agg(column_name, ',' ORDER BY ordinal) AS cols FROM ({union_all(parts)}) WHERE k > 0)"


def _eda_flags_sql(table, target):
    kinds = [k for _, _, k in _schema(table)]
    tgt_kind = dict((c_, k) for c_, _, k in _schema(table))[target]
    cat_target = tgt_kind == "categorical"
    if not cat_target:
        imb = "FALSE"
    else:
        imb = (f"(SELECT max(n) * 1.0 / min(n) > 3 FROM (SELECT count(*) AS n FROM {_src(table)} "
               f"WHERE {q(target)} IS NOT NULL GROUP BY {q(target)}))")
    body = f"""
  SELECT 'handle_missing' AS code, columns_with_missing AS detail FROM qr WHERE n_columns_with_missing > 0
  UNION ALL SELECT 'remove_duplicates', CAST(n_duplicates AS VARCHAR) FROM qr WHERE n_duplicates > 0
  UNION ALL SELECT 'review_outliers', cols FROM {_outlier_cols_sql(table)} o WHERE cols IS NOT NULL
  UNION ALL SELECT 'address_imbalance', {lit(target)} WHERE {imb}
  UNION ALL SELECT 'encode_categorical', '{kinds.count('categorical')}' WHERE {kinds.count('categorical')} > 0
  UNION ALL SELECT 'scale_numeric', '{kinds.count('numeric')}' WHERE {kinds.count('numeric')} > 0"""
    return f"""
SELECT {lit(table)} AS table_name, code, detail FROM (
  SELECT * FROM ({body}) f
  UNION ALL SELECT 'clean', '' WHERE NOT EXISTS (SELECT 1 FROM ({body}) g)
) r"""


@register("eda_flags",
          union_all([f"SELECT * FROM {_with_qr(t, _eda_flags_sql(t, tg))}" for t, tg in EDA_TABLES.items()]))
def eda_flags(spark, sf):
    out = None
    for t, tg in EDA_TABLES.items():
        part = R.eda_flags(_load(spark, sf, t), tg).select(F.lit(t).alias("table_name"), "code", "detail")
        out = part if out is None else out.unionByName(part)
    return out
