"""Report assembly queries (V12). Each section is an operator that is checked
against DuckDB on its own; these names check the assembly by row count."""

from __future__ import annotations

from ..sources.scan import read_table
from . import report as RP
from . import rule_queries as RQ
from .common import lit, union_all
from .registry import register

SUMMARY = ["modality", "task_type", "n_samples", "n_features", "target_column", "numeric_features", "categorical_features", "datetime_features"]
QUALITY = ["n_rows", "n_columns", "missing_cell_pct", "n_columns_with_missing", "columns_with_missing", "n_duplicates", "duplicate_pct",
           "constant_features", "high_cardinality_features", "potential_id_columns"]


def _long_sql(section: str, metrics: list[str], src: str) -> str:
    return union_all([f"SELECT {lit(section)} AS section, CAST(NULL AS VARCHAR) AS subject, {lit(m)} AS metric, CAST({m} AS VARCHAR) AS value FROM {src}"
                      for m in metrics])


def _strategy_sql(table: str) -> str:
    """The summary, quality, risk and step rows of a table, put in the report's long form."""
    target = RQ.SUMMARY_TABLES[table]
    rows = lambda section, sql: (f"SELECT {lit(section)} AS section, code AS subject, 'detail' AS metric, detail AS value FROM ({sql})")
    return union_all([f"SELECT * FROM (WITH s AS ({RQ._summary_sql(table, target)}) {_long_sql('summary', SUMMARY, 's')})",
                      f"SELECT * FROM (WITH k AS ({RQ._quality_cte(table)}) {_long_sql('quality', QUALITY, 'k')})",
                      rows("risks", f"SELECT * FROM {RQ._with_qr(table, RQ._risk_sql(table))}"),
                      rows("preprocessing", f"SELECT * FROM {RQ._with_qr(table, RQ._flags_sql(table, target))}")])


@register("eda_report_tabular")
def eda_report_tabular(spark, sf):
    """Tabular EDA report frame (section, subject, metric, value) of ``orders``."""
    return RP.eda_report(read_table(spark, sf, "orders"), "tabular")


@register("strategy_report_supplier", _strategy_sql("supplier"))
def strategy_report_supplier(spark, sf):
    """Summary, quality, risks and preprocessing steps of ``supplier``."""
    return RP.strategy_report(read_table(spark, sf, "supplier"))
