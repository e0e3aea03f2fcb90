"""Queries over a long run-metrics table.

The table has one row per (run, metric): run_id, version, model, status,
metric, value. It replaces the reference's per-run JSON records; every query
is an aggregation, a window or a pivot over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_runs(runs: DataFrame, metric: str, higher_is_better: bool = True,
              version: str | None = None, per_version: bool = True) -> DataFrame:
    """Best completed run for ``metric`` (per version, or overall); ties by run_id (K7)."""
    r = runs.where((F.col("metric") == metric) & (F.col("status") == "completed")
                   & F.col("value").isNotNull())
    if version is not None:
        r = r.where(F.col("version") == version)
    order = F.col("value").desc() if higher_is_better else F.col("value").asc()
    cols = ["version", "run_id", "model", F.col("value").alias(metric)]
    if not per_version:
        return r.orderBy(order, F.col("run_id")).limit(1).select(*cols)
    w = Window.partitionBy("version").orderBy(order, F.col("run_id"))
    return r.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).select(*cols)


def runs_by(runs: DataFrame, version: str | None = None, model: str | None = None) -> DataFrame:
    """Runs of one version and / or one model."""
    r = runs
    if version is not None:
        r = r.where(F.col("version") == version)
    if model is not None:
        r = r.where(F.col("model") == model)
    return r


def compare_runs(runs: DataFrame, metrics: list, run_ids: list | None = None) -> DataFrame:
    """One row per run with the chosen metrics side by side (V11); missing -> NULL."""
    r = runs if run_ids is None else runs.where(F.col("run_id").isin(list(run_ids)))
    return (r.groupBy("run_id", "version", "model", "status")
            .pivot("metric", list(metrics)).agg(F.first("value")))


def runs_summary(runs: DataFrame) -> DataFrame:
    """Totals by status, distinct versions and models with their sorted lists."""
    per_run = runs.select("run_id", "version", "model", "status").distinct()
    return per_run.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(~F.col("status").isin("completed", "failed")).alias("running"),
        F.count_distinct("version").alias("unique_versions"),
        F.count_distinct("model").alias("unique_models"),
        F.array_join(F.sort_array(F.collect_set("version")), ",").alias("versions"),
        F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"))
