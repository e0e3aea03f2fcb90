"""Role, modality and task inference plus rule reports over profile numbers
(V2, V4, V6-V9).

The name rules run on the schema on the driver; only mean string lengths,
distinct counts and the quality numbers need jobs (one aggregation each).
Reports are small frames of (code, detail) rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (ID_NAMES, TARGET_NAMES, TEXT_NAMES, TIME_NAMES, c,
                                 guess_target, type_class)
from ..sources.scan import normalise_missing
from . import profile as P

MODALITY_MAX_TS_COLUMNS = 10   # fixed value: time-named tables wider than this stay tabular
NLP_MIN_AVG_LENGTH = 100.0     # fixed value: mean length that makes a text-named column "text"


def column_roles(df: DataFrame) -> DataFrame:
    """One row per column: type, name-rule roles and mean string length (V7)."""
    fields = df.schema.fields
    strings = [f.name for f in fields if type_class(f.dataType) == "categorical"]
    aggs = [F.avg(F.length(c(s))).alias(f"l{i}") for i, s in enumerate(strings)] or [F.lit(None).alias("__none")]
    wide = df.agg(*aggs)
    lower_targets = [t.lower() for t in TARGET_NAMES]
    structs = []
    for i, f in enumerate(fields):
        name = f.name
        avg_len = F.col(f"l{strings.index(name)}") if name in strings else F.lit(None).cast("double")
        structs.append(F.struct(
            F.lit(name).alias("column_name"), F.lit(i).alias("ordinal"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(type_class(f.dataType)).alias("type_class"),
            F.lit(name.lower() in TIME_NAMES).alias("is_time_name"),
            F.lit(name.lower() in TEXT_NAMES).alias("is_text_name"),
            F.lit(name.lower() in lower_targets).alias("is_target_name"),
            F.lit(name in ID_NAMES).alias("is_id_name"),
            avg_len.cast("double").alias("avg_length")))
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def detect_modality(df: DataFrame, roles: list | None = None) -> str:
    """timeseries / nlp / tabular from the column roles (V7, rules in SURVEY §1.3)."""
    roles = roles if roles is not None else column_roles(df).collect()
    if any(r["is_time_name"] for r in roles) and len(df.columns) <= MODALITY_MAX_TS_COLUMNS:
        return "timeseries"
    for r in roles:
        if r["is_text_name"] and r["type_class"] == "categorical" and \
                r["avg_length"] is not None and r["avg_length"] > NLP_MIN_AVG_LENGTH:
            return "nlp"
    return "tabular"


def task_type(df: DataFrame, target: str) -> DataFrame:
    """(target, n_rows, n_distinct, is_numeric, task_type) (V8)."""
    df = normalise_missing(df)
    kind = type_class(df.schema[target].dataType)
    numeric = kind in ("numeric", "boolean")
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(c(target)).alias("n_distinct"))
    k, n = F.col("n_distinct"), F.col("n_rows")
    if numeric:
        t = (F.when(k <= 10, F.when(k == 2, "binary_classification").otherwise("multiclass_classification"))
             .when(k / n < 0.05, "multiclass_classification").otherwise("regression"))
    else:
        t = F.when(k == 2, "binary_classification").otherwise("multiclass_classification")
    return agg.select(F.lit(target).alias("target"), "n_rows", "n_distinct",
                      F.lit(numeric).alias("is_numeric"), t.alias("task_type"))


def _task_label(numeric: bool, k: int, n: int) -> str:
    if numeric:
        if k <= 10:
            return "binary_classification" if k == 2 else "multiclass_classification"
        return "multiclass_classification" if n and k / n < 0.05 else "regression"
    return "binary_classification" if k == 2 else "multiclass_classification"


def dataset_summary(df: DataFrame, target: str | None = None) -> DataFrame:
    """Modality, task, counts per type class, target (V9); one row.

    One aggregation: mean length of every string column (for the modality
    rule), row count and distinct count of the target (for the task rule).
    """
    df = normalise_missing(df)
    target = target or guess_target(df.columns)
    fields = df.schema.fields
    kinds = {f.name: type_class(f.dataType) for f in fields}
    strings = [f.name for f in fields if kinds[f.name] == "categorical"]
    row = df.agg(F.count(F.lit(1)).alias("__n"), F.countDistinct(c(target)).alias("__k"),
                 *[F.avg(F.length(c(x))).alias(f"l{i}") for i, x in enumerate(strings)]).first()
    roles = [{"is_time_name": f.name.lower() in TIME_NAMES, "is_text_name": f.name.lower() in TEXT_NAMES,
              "type_class": kinds[f.name],
              "avg_length": row[f"l{strings.index(f.name)}"] if f.name in strings else None}
             for f in fields]
    modality = detect_modality(df, roles)
    numeric = kinds[target] in ("numeric", "boolean")
    n, k = row["__n"], row["__k"]
    counts = list(kinds.values())
    out = [(modality, _task_label(numeric, k, n), n, len(df.columns) - 1, target,
            counts.count("numeric"), counts.count("categorical"), counts.count("datetime"))]
    return df.sparkSession.createDataFrame(
        out, "modality string, task_type string, n_samples bigint, n_features int, target_column string, "
             "numeric_features int, categorical_features int, datetime_features int")


class Findings:
    """What the rules ask of one table, each part computed when first asked for and then shared: the
    summary and quality rows, the outlier rows and the target profile (all bounded by the schema)."""

    def __init__(self, df: DataFrame, target: str | None = None):
        self.df, self.target = df, target

    @cached_property
    def summary(self):
        return dataset_summary(self.df, self.target).first()

    @cached_property
    def quality(self):
        return P.quality_report(self.df).first()

    @cached_property
    def outliers(self) -> DataFrame:
        found = P.iqr_outliers(self.df)
        return self.df.sparkSession.createDataFrame(found.collect(), found.schema)  # a row per numeric column

    @cached_property
    def target_profile(self) -> tuple:
        return P.target_profile(self.df, self.target or self.df.columns[-1])


def _report(spark, rows):
    return spark.createDataFrame(rows, "code string, detail string")


def risks(df: DataFrame, target: str | None = None, found: Findings | None = None) -> DataFrame:
    """Risk rows from the summary and the quality report (V2)."""
    found = found or Findings(df, target)
    s, qr = found.summary, found.quality
    n, k = s["n_samples"], s["n_features"]
    out = []
    if n < 100:
        out.append(("very_small_dataset", f"{n} rows: fewer than 100, models overfit easily"))
    elif n < 1000:
        out.append(("small_dataset", f"{n} rows: fewer than 1000, prefer simple models"))
    if k > n:
        out.append(("more_features_than_samples", f"{k} features for {n} rows"))
    miss = qr["missing_cell_pct"] or 0.0
    if miss > 30:
        out.append(("high_missing", f"{round(miss, 2)} % of cells missing"))
    elif miss > 10:
        out.append(("moderate_missing", f"{round(miss, 2)} % of cells missing"))
    if qr["constant_features"]:
        out.append(("constant_features", qr["constant_features"]))
    if qr["potential_id_columns"]:
        out.append(("potential_id_columns", qr["potential_id_columns"]))
    return _report(df.sparkSession, out)


def preprocessing_steps(df: DataFrame, target: str | None = None, found: Findings | None = None) -> DataFrame:
    """Suggested preprocessing steps (V4) as code rows; see :func:`eda_flags` for V6."""
    found = found or Findings(df, target)
    s, qr = found.summary, found.quality
    out = []
    if qr["columns_with_missing"]:
        out.append(("impute_missing", qr["columns_with_missing"]))
    if qr["constant_features"]:
        out.append(("drop_constant", qr["constant_features"]))
    if qr["potential_id_columns"]:
        out.append(("drop_id_columns", qr["potential_id_columns"]))
    if qr["n_duplicates"] > 0:
        out.append(("drop_duplicates", str(qr["n_duplicates"])))
    if s["categorical_features"] > 0:
        out.append(("encode_categorical", str(s["categorical_features"])))
    if s["numeric_features"] > 0:
        out.append(("scale_numeric", str(s["numeric_features"])))
    if "classification" in s["task_type"]:
        out.append(("check_class_balance", s["target_column"]))
    return _report(df.sparkSession, out)


def eda_flags(df: DataFrame, target: str | None = None, found: Findings | None = None) -> DataFrame:
    """Tabular EDA recommendations (V6): missing, duplicates, outliers, imbalance,
    encoding, scaling; 'clean' when none applies."""
    target = target or df.columns[-1]
    found = found or Findings(df, target)
    qr = found.quality
    out = []
    if qr["n_columns_with_missing"] > 0:
        out.append(("handle_missing", qr["columns_with_missing"]))
    if qr["n_duplicates"] > 0:
        out.append(("remove_duplicates", str(qr["n_duplicates"])))
    outl = found.outliers.select("column").collect()
    if outl:
        out.append(("review_outliers", ",".join(r["column"] for r in outl)))
    kind, prof = found.target_profile
    if kind == "categorical":
        first = prof.select("is_imbalanced").first()
        if first is not None and first["is_imbalanced"]:
            out.append(("address_imbalance", target))
    kinds = [type_class(f.dataType) for f in df.schema.fields]
    if "categorical" in kinds:
        out.append(("encode_categorical", str(kinds.count("categorical"))))
    if "numeric" in kinds:
        out.append(("scale_numeric", str(kinds.count("numeric"))))
    if not out:
        out.append(("clean", ""))
    return _report(df.sparkSession, out)


def series_flags(stationarity_row) -> list:
    """Time-series recommendation (V6): difference a series that is not stationary."""
    if stationarity_row is not None and stationarity_row["likely_stationary"] is False:
        return [("difference_series", "variance ratio >= 2")]
    return []
