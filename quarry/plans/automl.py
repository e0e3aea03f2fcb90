"""Composed workflows: feature build (E8), automatic training (M7), benchmark
mode (M8), evaluation (M15) and submission (M16)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ID_NAMES, c, guess_target, type_class
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import rules as R
from ..operators import scoring as SC
from ..operators import splits as SP
from ..operators.prediction_store import PredictionStore
from ..session import cut_lineage
from ..sources.scan import normalise_missing, read_path

# Model lists per task (at most five per automatic run).
DEFAULT_MODELS = {
    MD.CLASSIFICATION: ["logistic_regression", "random_forest_classifier",
                        "gradient_boosting_classifier", "decision_tree_classifier", "gaussian_nb"],
    MD.REGRESSION: ["linear_regression", "ridge_regression", "random_forest_regressor",
                    "gbt_regressor", "decision_tree_regressor"],
}
BENCHMARK_MODELS = {
    MD.CLASSIFICATION: ["logistic_regression", "random_forest_classifier", "lightgbm", "xgboost"],
    MD.REGRESSION: ["linear_regression", "random_forest_regressor", "lightgbm", "xgboost"],
}


def build_features(df: DataFrame, target: str | None = None, strategy: str = "basic",
                   out_path: str | None = None):
    """Last column (or ``target``) is the target; fit + transform, target carried
    through, optional Parquet sink (E8). Returns (frame, model, counts)."""
    target = target or df.columns[-1]
    model = FE.fit(df, target, strategy)
    out = model.transform(df, keep=(target,))
    counts = {"input_columns": len(df.columns), "output_columns": len(out.columns)}
    if out_path:
        out.write.mode("errorifexists").parquet(out_path)
    return out, model, counts


def with_row_key(df: DataFrame, key: str = "__row") -> DataFrame:
    """Row identity when the table has no key (D3): a 64-bit hash of all columns.

    Identical rows share a key, so hash splits keep copies on the same side
    (no duplicate leaks from training into validation); nothing joins on it.
    """
    return df.withColumn(key, F.xxhash64(*[c(x) for x in df.columns]))


@dataclass
class AutoTrainResult:
    task: str
    target: str
    features: FE.FeatureModel
    run: MD.MultiModelRun
    labels: DataFrame | None  # (value, code) of a classification target
    feature_cols: list

    def best(self):
        return self.run.best()


def _task_family(task_type: str) -> str:
    return MD.REGRESSION if task_type == "regression" else MD.CLASSIFICATION


def auto_train(df: DataFrame, target: str | None = None, models=None, metric: str | None = None,
               overrides: dict | None = None, time_budget_s: float | None = None,
               key: str | None = None, store: PredictionStore | None = None,
               version: str | None = None) -> AutoTrainResult:
    """Detect task, encode features, split 80/20 by hash, train the task's models,
    rank them (M7). Each fit is an MLlib job; the driver only names and ranks them.

    With a ``store`` (whose key type is that of ``key``) the version's validation labels, the
    predictions and scores of every model and the best model are kept there. That needs a unique
    ``key``: the hash that stands in for a missing one is shared by identical rows."""
    if store is not None and (key is None or version is None):
        raise ValueError("storing a training needs a key column and a version")
    df = normalise_missing(df)
    target = target or guess_target(df.columns)
    task_type = R.task_type(df, target).first()["task_type"]
    task = _task_family(task_type)
    if key is None:
        df, key = with_row_key(df), "__row"
    # Rows without a target train and validate nothing.
    df = df.where(c(target).isNotNull())
    feats = FE.fit(df, target, "basic", exclude=(key,))
    labels = None
    if task == MD.CLASSIFICATION:
        labels = cut_lineage(FE.fit_category_codes(df, target))
        # Codes replace the target in place (a join on the value, never on the row key,
        # so identical rows sharing a hash key cannot multiply).
        labelled = (FE.category_codes(df, [target], fitted={target: labels})
                    .withColumn("label", c(target).cast("double")).drop(target))
    else:
        labelled = df.withColumn("label", c(target).cast("double"))
    x = feats.transform(labelled, keep=(key, "label"))
    x = MD.assemble(x, feats.feature_names)
    # Encoded once, read by every fit.
    x = cut_lineage(SP.holdout(x, key))
    train, valid = x.where(F.col("split") == "train"), x.where(F.col("split") == "valid")
    names = list(models) if models is not None else DEFAULT_MODELS[task][:5]
    overrides = dict(overrides or {})
    for name in names:
        if name.startswith("knn_"):
            overrides[name] = {"idCol": key, **overrides.get(name, {})}
    run = MD.train_models(train, valid, names, task, "label", metric=metric, overrides=overrides,
                          time_budget_s=time_budget_s)
    if run.best() is None:
        raise ValueError("no model could be fitted: " + "; ".join(f"{r.model_name}: {r.error}" for r in run.results))
    if store is not None:
        store.write_training(version, task, run, valid, key, probability=MD.positive_score if task == MD.CLASSIFICATION else None)
    return AutoTrainResult(task, target, feats, run, labels, feats.feature_names)


def benchmark(df: DataFrame, target: str | None = None, key: str | None = None,
              overrides: dict | None = None, rows: int = 5000) -> AutoTrainResult:
    """Benchmark mode (M8): four models on at most ``rows`` rows (lowest hashes)."""
    if key is None:
        df, key = with_row_key(df), "__row"
    sample = SP.sample_rows(df, key, rows)
    target = target or guess_target([x for x in df.columns if x != key])
    task = _task_family(R.task_type(sample, target).first()["task_type"])
    return auto_train(sample, target, BENCHMARK_MODELS[task],
                      overrides=overrides, key=key)


def evaluate(pred: DataFrame, task: str, key: str, mode: str = "full") -> dict:
    """Metrics plus error analysis (M15): 'quick' skips the error rows,
    'failures_only' returns only them."""
    out = {}
    if mode != "failures_only":
        out["metrics"] = (M.regression_metrics(pred) if task == MD.REGRESSION
                          else M.classification_metrics(pred))
        if task == MD.CLASSIFICATION:
            out["confusion"] = M.confusion(pred)
    if mode in ("full", "failures_only") and task == MD.CLASSIFICATION:
        out["errors"] = M.error_rows(pred, key)
    return out


def submission(result: AutoTrainResult, test: DataFrame, id_col: str | None = None,
               out_path: str | None = None):
    """Score new rows with the best model; validate; optional CSV sink.

    Rows without an id column get one from the raw rows, before any encoding: the position in
    the order of all their columns, which :func:`scoring.with_synthetic_id` gives again."""
    best = result.best()
    x = normalise_missing(test)
    id_col = id_col or next((n for n in ID_NAMES if n in x.columns), None)
    if id_col is None:
        x, id_col = cut_lineage(SC.with_synthetic_id(x)), "id"
    feats = MD.assemble(result.features.transform(x, keep=(id_col,)), result.feature_cols)
    sub = SC.score(best.model, feats, result.target, id_col, labels=result.labels)
    report = SC.validate(sub)
    if out_path:
        SC.write_submission(sub, out_path)
    return sub, report


def auto_train_path(spark, path: str, target: str | None = None, **kw) -> AutoTrainResult:
    """:func:`auto_train` of the table under ``path`` (csv, tsv, parquet, json, jsonl)."""
    return auto_train(read_path(spark, path), target, **kw)


def submission_path(spark, result: AutoTrainResult, path: str, id_col: str | None = None, out_path: str | None = None):
    """:func:`submission` of the rows under ``path``."""
    return submission(result, read_path(spark, path), id_col, out_path)


__all__ = ["auto_train_path", "submission_path", "build_features", "auto_train", "benchmark", "evaluate", "submission", "type_class"]
