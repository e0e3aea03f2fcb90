"""Stored predictions and labels of trained versions.

A store is a folder with three tables:

* ``predictions`` (key, prediction, score) partitioned by version and model, bucketed and sorted by key;
* ``labels`` (key, label) partitioned by version, bucketed and sorted alike;
* ``runs`` (version, model, task, metric, score, is_best): one row per trained model.

Training writes them; evaluation joins labels and predictions, and ensembles group predictions, on
the bucketed key, so neither shuffles: bucket *i* of one table meets bucket *i* of the other in one
task. Buckets are as many as the store was created with, so a stored table grows by files, not by
partitions of a later shuffle. Writing repartitions by the key into the same buckets, which gives
one file per bucket and partition.

Keys are unique within a version's labels and within a model's predictions: a key met twice is
refused when it is written. Rows with a null key are refused, too, since no join could find them;
rows with a null label or prediction are kept and take no part in a regression metric. A version and
model written again replace the earlier ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import c
from . import metrics as M
from . import persistence

REGRESSION = "regression"


class PredictionStore:
    """Opens (or creates) the store under ``path``, which all executors must reach.

    ``key_type`` and ``buckets`` count when the store is created; later they are read from it."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint", buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        found = self._layout()
        if found is None:
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(key_type, buckets)], "key_type string, buckets int").coalesce(1).write.json(f"{self.path}/layout")
            found = (key_type, buckets)
        self.key_type, self.buckets = found
        name = uuid.uuid4().hex
        self.predictions = self._table(f"predictions_{name}", "predictions", "prediction double, score double", "version, model")
        self.labels = self._table(f"labels_{name}", "labels", "label double", "version")

    def _exists(self, folder: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _layout(self) -> tuple[str, int] | None:
        if not self._exists("layout"):
            return None
        row = self.spark.read.schema("key_type string, buckets int").json(f"{self.path}/layout").first()
        return row["key_type"], row["buckets"]

    def _table(self, name: str, folder: str, columns: str, partitions: str) -> str:
        """The folder under a name of this session's catalogue, with its layout and partitions."""
        parted = ", ".join(f"{x.strip()} string" for x in partitions.split(","))
        self.spark.sql(f"CREATE TABLE {name} (key {self.key_type}, {columns}, {parted}) USING parquet "
                       f"PARTITIONED BY ({partitions}) CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS "
                       f"LOCATION '{self.path}/{folder}'")
        if self._exists(folder):  # partitions that another session wrote
            self.spark.catalog.recoverPartitions(name)
        return name

    # ------------------------------------------------------------------------------- writing
    def _put(self, table: str, rows: DataFrame) -> None:
        n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(
            F.max("n").alias("most"), F.count_if(F.col("key").isNull()).alias("nulls")).first()
        if n["nulls"]:
            raise ValueError("rows without a key cannot be stored")
        if (n["most"] or 0) > 1:
            raise ValueError("a key stands in more than one row")
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")  # only the version and model at hand are replaced
        try:
            rows.repartition(self.buckets, "key").write.insertInto(table, overwrite=True)
        finally:
            self.spark.conf.set(mode, before)

    def write_labels(self, version: str, rows: DataFrame, key: str, label: str = "label") -> None:
        self._put(self.labels, rows.select(c(key).cast(self.key_type).alias("key"), c(label).cast("double").alias("label"),
                                           F.lit(version).alias("version")))

    def write_predictions(self, version: str, model: str, rows: DataFrame, key: str, prediction: str = "prediction",
                          score: str | None = None) -> None:
        value = c(score).cast("double") if score else F.lit(None).cast("double")
        self._put(self.predictions, rows.select(c(key).cast(self.key_type).alias("key"), c(prediction).cast("double").alias("prediction"),
                                                value.alias("score"), F.lit(version).alias("version"), F.lit(model).alias("model")))

    def write_runs(self, version: str, task: str, results: list[tuple[str, str, float]], best: str | None = None) -> None:
        """``results``: (model, metric, score) of the models that were fitted; the best is the one
        with the highest score unless named."""
        best = best or max(results, key=lambda r: r[2])[0]
        rows = [(version, m, task, metric, float(score), m == best) for m, metric, score in results]
        self.spark.createDataFrame(rows, "version string, model string, task string, metric string, score double, is_best boolean") \
            .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/runs/{version}")

    def model_path(self, version: str) -> str:
        return f"{self.path}/models/{version}"

    def write_training(self, version: str, task: str, run, valid: DataFrame, key: str, label: str = "label",
                       probability=None) -> None:
        """Labels, predictions of every fitted model, runs and the best model of one training.

        ``run`` is a :class:`models.MultiModelRun`; ``probability(frame, out)`` may add a score column."""
        done = [r for r in run.results if r.error is None and r.score is not None]
        if not done:
            raise ValueError("no model was fitted")
        self.write_labels(version, valid, key, label)
        for r in done:
            rows = probability(r.predictions, "__score") if probability else r.predictions
            self.write_predictions(version, r.model_name, rows, key, score="__score" if probability else None)
        self.write_runs(version, task, [(r.model_name, r.metric, r.score) for r in done], run.best().model_name)
        persistence.save(run.best().model, self.model_path(version))

    # ------------------------------------------------------------------------------- reading
    def runs(self, *versions: str) -> DataFrame:
        """One row per model of the versions (all, if none is named)."""
        at = [f"{self.path}/runs/{v}" for v in versions] or [f"{self.path}/runs/*"]
        missing = [v for v in versions if not self._exists(f"runs/{v}")]
        if missing:
            raise ValueError(f"versions not found: {', '.join(missing)}")
        return self.spark.read.parquet(*at)

    def best(self, version: str) -> dict:
        return self.runs(version).where("is_best").first().asDict()

    def load_best(self, version: str):
        return persistence.load(self.model_path(version), self.spark)

    def predicted(self, version: str, model: str | None = None) -> DataFrame:
        """(key, prediction, score, model) of one version, of all its models or of one."""
        rows = self.spark.table(self.predictions).where(F.col("version") == version)
        return (rows if model is None else rows.where(F.col("model") == model)).drop("version")

    def truth(self, version: str) -> DataFrame:
        return self.spark.table(self.labels).where(F.col("version") == version).drop("version")

    def scored(self, version: str, model: str | None = None) -> DataFrame:
        """(key, label, prediction, score, model): labels joined with predictions (J3), without a shuffle."""
        # Both sides lie bucketed and sorted by key: a merge join reads bucket with bucket.
        return self.truth(version).hint("merge").join(self.predicted(version, model), "key")


def evaluate_version(store: PredictionStore, version: str, model: str | None = None, mode: str = "full", k: int = 100) -> dict:
    """Metrics (and for classes the confusion counts) and wrong rows of a stored version's best
    model, or of the one named (M15): 'quick' leaves out the rows, 'failures_only' gives only them."""
    run = store.best(version) if model is None else store.runs(version).where(F.col("model") == model).first()
    if run is None:
        raise ValueError(f"version {version!r} has no model {model!r}")
    pred = store.scored(version, run["model"])
    out = {"version": version, "model": run["model"], "metric": run["metric"], "score": run["score"], "task": run["task"]}
    regression = run["task"] == REGRESSION
    if mode != "failures_only":
        out["metrics"] = M.regression_metrics(pred) if regression else M.classification_metrics(pred)
        if not regression:
            out["confusion"] = M.confusion(pred)
    if mode != "quick" and not regression:
        out["errors"] = M.error_rows(pred.select("key", "label", "prediction"), "key", k=k)
    return out


def ensemble_versions(store: PredictionStore, versions: list[str], method: str = "average", weights: list[float] | None = None) -> DataFrame:
    """(key, prediction, n_models): the best models of two or more versions combined.

    'average', 'weighted' by the versions' best scores, or the ``weights`` given in the order of the
    versions. Predictions lie bucketed by key, so the grouping does not shuffle."""
    if len(versions) < 2:
        raise ValueError("an ensemble needs at least 2 versions")
    if weights is not None and len(weights) != len(versions):
        raise ValueError("one weight per version")
    if method not in ("average", "weighted") and weights is None:
        raise ValueError(f"unknown ensemble method {method!r}")
    bests = [store.best(v) for v in versions]  # one row per version
    given = weights or ([b["score"] for b in bests] if method == "weighted" else [1.0] * len(bests))
    if sum(given) == 0:
        raise ValueError("the weights sum to 0")
    # One scan of the chosen partitions keeps the bucketing that a union of scans would lose.
    chosen, weight = F.lit(False), F.lit(None).cast("double")
    for b, w in zip(bests, given):
        mine = (F.col("version") == b["version"]) & (F.col("model") == b["model"])
        chosen, weight = chosen | mine, F.when(mine, F.lit(float(w))).otherwise(weight)
    rows = store.spark.table(store.predictions).where(chosen & F.col("prediction").isNotNull())
    return rows.groupBy("key").agg((F.sum(weight * F.col("prediction")) / F.sum(weight)).alias("prediction"),
                                   F.count(F.lit(1)).alias("n_models"))


def store_ensemble(store: PredictionStore, version: str, versions: list[str], method: str = "average",
                   weights: list[float] | None = None) -> dict:
    """Combine versions into a new one: its predictions, labels (of the first version) and score are
    stored, so that it can be evaluated like any other. Class predictions are rounded to a class."""
    run = store.best(versions[0])
    rows = ensemble_versions(store, versions, method, weights)
    if run["task"] != REGRESSION:
        rows = rows.withColumn("prediction", F.round("prediction"))
    store.write_predictions(version, "ensemble", rows, "key")
    store.write_labels(version, store.truth(versions[0]), "key")
    pred = store.scored(version, "ensemble")
    m = (M.regression_metrics(pred) if run["task"] == REGRESSION else M.classification_metrics(pred)).first()
    metric = "r2" if run["task"] == REGRESSION else "accuracy"
    store.write_runs(version, run["task"], [("ensemble", metric, m[metric])])
    return {"ensemble_version": version, "component_versions": list(versions), "method": method, metric: m[metric]}


__all__ = ["PredictionStore", "ensemble_versions", "evaluate_version", "store_ensemble"]
