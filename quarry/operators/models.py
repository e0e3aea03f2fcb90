"""Model catalogue and model operators on ``pyspark.ml``.

Every model is an MLlib ``Estimator``; fitting is distributed by MLlib. The
driver only loops over a handful of model names or folds, as
``CrossValidator`` itself does.

Regularisation conventions (so the fitted coefficients equal the reference's
defaults, SURVEY §2.11): MLlib scales the L2 term by the label's population
std sigma, hence ridge ``regParam = alpha * sigma / n``; lasso
``regParam = alpha``; elastic net ``lambda = alpha * l1 + alpha * (1 - l1) * sigma``,
``elasticNetParam = alpha * l1 / lambda``; logistic regression with C = 1 is
``regParam = 1 / n``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import c
from ..session import cut_lineage
from . import metrics as M
from . import persistence
from .forest_cells import forest_on_cells
from .persistence import ModelSet, StoredModel
from .tree_cells import SharedCells, on_cells

CLASSIFICATION = "classification"
REGRESSION = "regression"
ANOMALY = "anomaly"


@dataclass
class DataStats:
    """Numbers some catalogue entries need: row count and label population std."""
    n: int
    label_std: float = 1.0
    n_classes: int = 2


def data_stats(df: DataFrame, label: str = "label", task: str = REGRESSION) -> DataStats:
    """Row count and label population std in one aggregation; the class count
    (an exact distinct count) only for classification."""
    aggs = [F.count(F.lit(1)).alias("n"), F.stddev_pop(c(label).cast("double")).alias("s")]
    if task == CLASSIFICATION:
        aggs.append(F.countDistinct(c(label)).alias("k"))
    row = df.agg(*aggs).first()
    k = row["k"] if task == CLASSIFICATION else None
    return DataStats(row["n"], row["s"] or 1.0, k or 2)


class ShiftedNaiveBayes(Estimator, HasFeaturesCol, HasLabelCol):
    """Multinomial naive Bayes that takes any numbers: a feature with negative values (a standardised
    one) is shifted by its least training value, as counts cannot be negative; others stay as they are."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", **kw):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol)
        self.settings = kw

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def _fit(self, df: DataFrame):
        low = df.agg(Summarizer.min(F.col(self.getFeaturesCol())).alias("low")).first()["low"]
        least = [min(0.0, float(x)) for x in low.toArray()] if low is not None else []
        inner = NaiveBayes(modelType="multinomial", featuresCol="__counts", labelCol=self.getLabelCol(), **self.settings)
        model = ShiftedModel(least, self.getFeaturesCol(), None)
        model.inner = inner.fit(model.shifted(df))
        return model


class ShiftedModel(StoredModel):
    """Shifts features to be non-negative, then applies the inner model."""

    def __init__(self, least: list, features_col: str, inner: Model):
        super().__init__()
        self.least, self.features_col, self.inner = least, features_col, inner

    def state(self):
        return {"least": self.least, "features_col": self.features_col}, {}, {"inner": self.inner}

    @classmethod
    def from_state(cls, values, frames, models):
        return cls(inner=models["inner"], **values)

    def shifted(self, df: DataFrame) -> DataFrame:
        if not any(self.least):
            return df.withColumn("__counts", F.col(self.features_col))
        least = F.array(*[F.lit(x) for x in self.least])
        # A value below the training minimum counts as the minimum.
        moved = F.zip_with(vector_to_array(F.col(self.features_col)), least, lambda x, low: F.greatest(x - low, F.lit(0.0)))
        return df.withColumn("__counts", array_to_vector(moved))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.inner.transform(self.shifted(df)).drop("__counts")


def _gbt_classifier(stats: DataStats, **kw):
    kw.setdefault("maxDepth", 3)
    gbt = GBTClassifier(maxIter=kw.pop("maxIter", 100), stepSize=kw.pop("stepSize", 0.1), seed=42, **kw)
    if stats.n_classes > 2:
        return OneVsRest(classifier=gbt)
    return gbt


# The reference's default hyper-parameters, re-expressed for MLlib.
def _catalogue():
    def ridge(s, alpha=1.0, **kw):
        return LinearRegression(regParam=alpha * s.label_std / s.n, elasticNetParam=0.0,
                                standardization=False, solver="normal", **kw)

    def lasso(s, alpha=1.0, **kw):
        return LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, **kw)

    def enet(s, alpha=1.0, l1_ratio=0.5, **kw):
        lam = alpha * l1_ratio + alpha * (1 - l1_ratio) * s.label_std
        return LinearRegression(regParam=lam, elasticNetParam=alpha * l1_ratio / lam,
                                standardization=False, **kw)

    return {
        "linear_regression": ((REGRESSION,), lambda s, **kw: LinearRegression(regParam=0.0, solver="normal", **kw)),
        "ridge_regression": ((REGRESSION,), ridge),
        "lasso_regression": ((REGRESSION,), lasso),
        "elastic_net": ((REGRESSION,), enet),
        "logistic_regression": ((CLASSIFICATION,), lambda s, **kw: LogisticRegression(
            maxIter=kw.pop("maxIter", 1000), regParam=1.0 / s.n, standardization=False, **kw)),
        "gaussian_nb": ((CLASSIFICATION,), lambda s, **kw: NaiveBayes(modelType="gaussian", **kw)),
        "multinomial_nb": ((CLASSIFICATION,), lambda s, **kw: ShiftedNaiveBayes(**kw)),
        "decision_tree_classifier": ((CLASSIFICATION,), lambda s, **kw: DecisionTreeClassifier(
            maxDepth=kw.pop("maxDepth", 30), seed=42, **kw)),
        "decision_tree_regressor": ((REGRESSION,), lambda s, **kw: DecisionTreeRegressor(
            maxDepth=kw.pop("maxDepth", 30), seed=42, **kw)),
        "random_forest_classifier": ((CLASSIFICATION,), lambda s, **kw: RandomForestClassifier(
            numTrees=kw.pop("numTrees", 100), seed=42, **kw)),
        "random_forest_regressor": ((REGRESSION,), lambda s, **kw: RandomForestRegressor(
            numTrees=kw.pop("numTrees", 100), seed=42, **kw)),
        "gradient_boosting_classifier": ((CLASSIFICATION,), _gbt_classifier),
        "hist_gradient_boosting_classifier": ((CLASSIFICATION,), _gbt_classifier),
        "xgboost": ((CLASSIFICATION, REGRESSION), None),
        "lightgbm": ((CLASSIFICATION, REGRESSION), None),
        "catboost": ((CLASSIFICATION, REGRESSION), None),
        "gbt_regressor": ((REGRESSION,), lambda s, **kw: GBTRegressor(
            maxIter=kw.pop("maxIter", 100), stepSize=kw.pop("stepSize", 0.1), maxDepth=kw.pop("maxDepth", 3), seed=42, **kw)),
        "tfidf_logistic": ((CLASSIFICATION,), lambda s, **kw: tfidf_estimator(
            kw.pop("textCol", "text"), kw.pop("labelCol", "label"), "logistic", n=s.n, **kw)),
        "tfidf_svm": ((CLASSIFICATION,), lambda s, **kw: tfidf_estimator(
            kw.pop("textCol", "text"), kw.pop("labelCol", "label"), "svm", **kw)),
        "isolation_forest": ((ANOMALY,), lambda s, **kw: _iforest(**kw)),
        "knn_classifier": ((CLASSIFICATION,), lambda s, **kw: _knn(CLASSIFICATION, **kw)),
        "knn_regressor": ((REGRESSION,), lambda s, **kw: _knn(REGRESSION, **kw)),
    }


def _iforest(**kw):
    from .isoforest import IsolationForestEstimator
    return IsolationForestEstimator(**kw)


def _knn(task, **kw):
    from .knn import KNNEstimator
    return KNNEstimator(task=task, k=kw.pop("k", 5), **kw)


CATALOGUE = _catalogue()
# Boosting libraries are not installed; their names map to MLlib gradient-boosted trees.
BOOSTER_NAMES = ("xgboost", "lightgbm", "catboost")


def make_estimator(name: str, task: str, stats: DataStats, features_col: str = "features",
                   label_col: str = "label", **overrides) -> Estimator:
    """Build one catalogue model with its default parameters (M2); overrides allowed."""
    if name in BOOSTER_NAMES:
        name = "gradient_boosting_classifier" if task == CLASSIFICATION else "gbt_regressor"
    if name not in CATALOGUE:
        raise ValueError(f"model {name!r} is not in the catalogue")
    tasks, factory = CATALOGUE[name]
    if task not in tasks:
        raise ValueError(f"model {name!r} does not support task {task!r}")
    est = factory(stats, **overrides)
    inner = est.getClassifier() if isinstance(est, OneVsRest) else est
    for setter, value in (("setFeaturesCol", features_col), ("setLabelCol", label_col)):
        if hasattr(inner, setter):
            getattr(inner, setter)(value)
    if isinstance(est, OneVsRest):
        est.setFeaturesCol(features_col).setLabelCol(label_col)
    return est


def tfidf_estimator(text_col: str, label_col: str = "label", kind: str = "logistic",
                    num_features: int = 1 << 18, n: int | None = None) -> Pipeline:
    """tf-idf text classifier: tokens -> hashed term counts -> idf -> LR / linear SVM."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="__tokens", pattern=r"[\s\p{Z}]+",
                         toLowercase=True)
    tf = HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=num_features)
    idf = IDF(inputCol="__tf", outputCol="__tfidf")
    if kind == "logistic":
        clf = LogisticRegression(featuresCol="__tfidf", labelCol=label_col, maxIter=100,
                                 regParam=1.0 / n if n else 0.0, standardization=False)
    elif kind == "svm":
        clf = LinearSVC(featuresCol="__tfidf", labelCol=label_col, maxIter=100)
    else:
        raise ValueError(kind)
    return Pipeline(stages=[tok, tf, idf, clf])


# ---------------------------------------------------------------- prediction helpers
def positive_score(pred: DataFrame, out: str = "score") -> DataFrame:
    """Class-1 probability for two classes, max probability otherwise."""
    if "probability" not in pred.columns:
        return pred.withColumn(out, c("prediction").cast("double"))
    arr = vector_to_array(F.col("probability"))
    return pred.withColumn(out, F.when(F.size(arr) == 2, arr[1]).otherwise(F.array_max(arr)))


def assemble(df: DataFrame, feature_cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(feature_cols), outputCol=out,
                           handleInvalid="keep").transform(df)


def default_metric(df: DataFrame, label: str, task: str) -> str:
    """-MSE for floating targets, else accuracy (M9)."""
    if task == REGRESSION:
        return "neg_mse"
    return "accuracy"


def metric_in_use(pred: DataFrame, task: str, metric: str, label: str = "label") -> str:
    """The metric that :func:`score_predictions` gives: AUC needs two classes 0 and 1 and a
    probability; otherwise it is accuracy, under that name."""
    if task == REGRESSION or metric != "auc":
        return metric
    if "probability" not in pred.columns:
        return "accuracy"
    plain = pred.where(c(label).isNotNull() & ~c(label).cast("double").isin(0.0, 1.0)).isEmpty()
    kinds = pred.where(c(label).isNotNull()).select(c(label)).distinct().limit(3).count() if plain else 3
    return "auc" if kinds == 2 else "accuracy"


def score_predictions(pred: DataFrame, task: str, metric: str, label: str = "label") -> float:
    """One number per fitted model (M5): r2 / -mse / -mae, or accuracy / f1 / auc (see
    :func:`metric_in_use` for the fallback)."""
    if task == REGRESSION:
        m = M.regression_metrics(pred, label, "prediction").first()
        return {"r2": m["r2"], "mse": -m["mse"], "neg_mse": -m["mse"], "mae": -m["mae"]}.get(metric, m["r2"])
    metric = metric_in_use(pred, task, metric, label)
    if metric == "auc":
        return M.roc_auc(positive_score(pred), label, "score").first()["auc"]
    m = M.classification_metrics(pred, label, "prediction").first()
    return m["f1"] if metric == "f1" else m["accuracy"]


# ---------------------------------------------------------------- train many (M5, M6)
@dataclass
class TrainResult:
    model_name: str
    score: float | None
    metric: str
    training_time: float
    model: object = None
    error: str | None = None
    predictions: DataFrame | None = None


@dataclass
class MultiModelRun:
    results: list = field(default_factory=list)

    def rankings(self, spark) -> DataFrame:
        """(rank, model, score, metric, training_time) of the successful models."""
        rows = [(r.model_name, float(r.score), r.metric, float(r.training_time), i)
                for i, r in enumerate(self.results) if r.error is None and r.score is not None]
        df = spark.createDataFrame(rows, "model string, score double, metric string, "
                                         "training_time double, ordinal int")
        # One row per trained model: a handful of rows.
        w = Window.orderBy(F.col("score").desc(), F.col("ordinal"))
        return df.withColumn("rank", F.row_number().over(w)).drop("ordinal")

    def best(self):
        """Highest score among successful models (K6; no '> 0' rule)."""
        ok = [r for r in self.results if r.error is None and r.score is not None]
        return max(ok, key=lambda r: r.score) if ok else None

    def errors(self, spark) -> DataFrame:
        rows = [(r.model_name, r.error) for r in self.results if r.error is not None]
        return spark.createDataFrame(rows, "model string, error string")


def at_once(jobs: list, parallelism: int) -> list:
    """Results of ``jobs`` (functions without arguments) in their order, ``parallelism`` at a time.

    Each runs in a thread that inherits the caller's Spark properties, in a scheduler pool of its
    own, so that with ``spark.scheduler.mode`` FAIR their stages share the cluster instead of
    queueing; jobs leave executors idle between their stages, which the others then use."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    if parallelism <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    spark = SparkSession.active()

    def pooled(i, job):
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{i}")
            try:
                return job()
            finally:
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(min(parallelism, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(pooled(i, job)) for i, job in enumerate(jobs)]]


PARALLEL_FITS = 4


def train_models(train: DataFrame, valid: DataFrame, names, task: str, label: str = "label",
                 features_col: str = "features", metric: str | None = None,
                 overrides: dict | None = None, time_budget_s: float | None = None,
                 parallelism: int = PARALLEL_FITS) -> MultiModelRun:
    """Fit each named model on ``train``, score it on ``valid``, ``parallelism`` at once; a failing
    model is recorded with its error instead of stopping the run (M5). Results keep the order of
    ``names`` whatever finishes first; a model that a used-up time budget leaves is 'skipped'."""
    stats = data_stats(train, label, task)
    metric = metric or ("r2" if task == REGRESSION else "accuracy")
    start = time.time()
    shared = SharedCells(train)

    def fit(name: str) -> TrainResult:
        if time_budget_s is not None and time.time() - start > time_budget_s:
            return TrainResult(name, None, metric, 0.0, error="skipped: time budget used up")
        try:
            est = make_estimator(name, task, stats, features_col, label, **(overrides or {}).get(name, {}))
            est = forest_on_cells(on_cells(est, shared), shared)
            t0 = time.time()
            model = est.fit(train)
            fit_s = time.time() - t0
            pred = model.transform(valid)
            used = metric_in_use(pred, task, metric, label)
            return TrainResult(name, score_predictions(pred, task, used, label), used, fit_s, model, predictions=pred)
        except Exception as e:  # noqa: BLE001 - recorded per model
            return TrainResult(name, None, metric, 0.0, error=str(e)[:500])

    return MultiModelRun(at_once([lambda name=name: fit(name) for name in names], parallelism))


# ---------------------------------------------------------------- single train (M9)
def train_one(estimator: Estimator, train: DataFrame, valid: DataFrame, task: str,
              label: str = "label", metric_fn=None):
    """Fit, score on the validation frame; ``metric_fn`` is a user aggregate."""
    model = estimator.fit(train)
    pred = model.transform(valid)
    if metric_fn is not None:
        score = pred.agg(metric_fn(c(label), F.col("prediction")).alias("s")).first()["s"]
    else:
        score = score_predictions(pred, task, default_metric(train, label, task), label)
    return model, score


# ---------------------------------------------------------------- cross-validation
def cross_validate(df: DataFrame, model_factory, fold_col: str, task: str, label: str = "label",
                   k: int | None = None, metric_fn=None, time_budget_s: float | None = None,
                   ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per-fold scores and their summary.

    ``fold_col`` comes from :mod:`splits` (kfold / stratified / time series).
    ``ordered=True`` trains fold i on rows with ``train_from_fold <= i`` and tests
    on ``test_fold == i`` (expanding window); otherwise fold i is the test part.
    ``model_factory()`` returns a fresh Estimator (X2). Folds that ``time_budget_s`` leaves
    no time for have a null score and the status 'skipped', and take no part in the summary.
    """
    spark = df.sparkSession
    folds = k if k is not None else df.agg(F.max(fold_col)).first()[0] + 1
    scores = []
    start = time.time()
    for i in range(folds):
        if time_budget_s is not None and time.time() - start > time_budget_s:
            scores.append((i, None, "skipped"))
            continue
        if ordered:
            tr = df.where((F.col("train_from_fold") >= 0) & (F.col("train_from_fold") <= i))
            te = df.where(F.col("test_fold") == i)
        else:
            tr, te = df.where(F.col(fold_col) != i), df.where(F.col(fold_col) == i)
        model = model_factory().fit(tr)
        pred = model.transform(te)
        if metric_fn is not None:
            s = pred.agg(metric_fn(c(label), F.col("prediction")).alias("s")).first()["s"]
        else:
            s = score_predictions(pred, task, "neg_mse" if task == REGRESSION else "accuracy", label)
        scores.append((i, float(s), "done"))
    fs = spark.createDataFrame(scores, "fold int, score double, status string")
    return fs, M.cv_summary(fs.where("status = 'done'"))


# ---------------------------------------------------------------- hybrid
class GroupMeanRegressor(Estimator, HasLabelCol, HasPredictionCol):
    """Predicts the mean label of the row's group (one aggregation to fit)."""

    def __init__(self, groupCol: str = "group", labelCol: str = "label",
                 predictionCol: str = "prediction"):
        super().__init__()
        self.group_col = groupCol
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _fit(self, df: DataFrame):
        y = c(self.getLabelCol()).cast("double")
        sums = df.groupBy(c(self.group_col).alias("__g")).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
        sums = cut_lineage(sums)  # fitted state, made in one pass: one row per group
        overall = sums.agg(F.try_divide(F.sum("__s"), F.sum("__n"))).first()[0]
        means = sums.select("__g", F.try_divide(F.col("__s"), F.col("__n")).alias("__m"))
        return GroupMeanModel(self.group_col, means, overall, self.getPredictionCol())


class GroupMeanModel(StoredModel):
    """Means by group and over all rows; stored as one row per group."""

    def __init__(self, group_col, means, overall, prediction_col):
        super().__init__()
        self.group_col, self.means, self.overall, self.prediction_col = group_col, means, overall, prediction_col

    def state(self):
        values = {"group_col": self.group_col, "overall": self.overall, "prediction_col": self.prediction_col}
        return values, {"means": self.means}, {}

    @classmethod
    def from_state(cls, values, frames, models):
        return cls(means=frames["means"], **values)

    def _transform(self, df: DataFrame) -> DataFrame:
        from .features import sized
        j = df.join(sized(self.means), c(self.group_col).eqNullSafe(F.col("__g")), "left")
        return j.withColumn(self.prediction_col, F.coalesce(F.col("__m"), F.lit(self.overall))) \
            .drop("__g", "__m")


class HybridModel(StoredModel):
    """Base regressor plus a model of its residuals; prediction = base + residual."""

    def __init__(self, base: Model, residual: Model, base_pred_col: str = "base_prediction",
                 resid_pred_col: str = "residual_prediction"):
        super().__init__()
        self.base, self.residual = base, residual
        self.base_pred_col, self.resid_pred_col = base_pred_col, resid_pred_col

    def state(self):
        values = {"base_pred_col": self.base_pred_col, "resid_pred_col": self.resid_pred_col}
        return values, {}, {"base": self.base, "residual": self.residual}

    @classmethod
    def from_state(cls, values, frames, models):
        return cls(models["base"], models["residual"], **values)

    def _transform(self, df: DataFrame) -> DataFrame:
        b = self.base.transform(df).withColumnRenamed("prediction", self.base_pred_col)
        r = self.residual.transform(b).withColumnRenamed("prediction", self.resid_pred_col)
        return r.withColumn("prediction", F.col(self.base_pred_col) + F.col(self.resid_pred_col))


def hybrid_fit(df: DataFrame, base: Estimator, residual: Estimator, label: str = "label") -> HybridModel:
    """Fit ``base`` on y, then ``residual`` on y - base prediction."""
    base_model = base.fit(df)
    resid = base_model.transform(df).withColumn(
        "__resid", c(label).cast("double") - F.col("prediction")).drop("prediction")
    residual_model = residual.fit(resid, {residual.labelCol: "__resid"})
    return HybridModel(base_model, residual_model)


# ---------------------------------------------------------------- stacking
class StackingModel(StoredModel):
    """Base models whose predictions are the features of a meta model."""

    def __init__(self, base_models: dict, meta_model: Model, meta_cols: list, task: str):
        super().__init__()
        self.base_models, self.meta_model, self.meta_cols, self.task = base_models, meta_model, meta_cols, task

    def state(self):
        return {"meta_cols": self.meta_cols, "task": self.task}, {}, {"base": ModelSet(self.base_models), "meta": self.meta_model}

    @classmethod
    def from_state(cls, values, frames, models):
        return cls(models["base"].models, models["meta"], **values)

    def base_features(self, df: DataFrame) -> DataFrame:
        out = df
        for name, m in self.base_models.items():
            p = m.transform(out)
            p = positive_score(p, name) if self.task == CLASSIFICATION else \
                p.withColumn(name, F.col("prediction").cast("double"))
            out = p.drop(*[x for x in ("prediction", "probability", "rawPrediction") if x in p.columns])
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        feats = self.base_features(df)
        feats = VectorAssembler(inputCols=self.meta_cols, outputCol="__meta").transform(feats)
        return self.meta_model.transform(feats)


def stacking_fit(df: DataFrame, base: dict, meta: Estimator, fold_col: str, task: str,
                 key: str, label: str = "label", k: int = 5, parallelism: int = PARALLEL_FITS):
    """Out-of-fold base predictions as meta features, meta model on them, base
    models refitted on all rows (M12, J6). Returns (model, oof frame). All
    models x (k + 1) fits are independent and run ``parallelism`` at once.

    For each fold the base models fit on the other folds and predict the fold;
    the per-fold outputs are unioned (each row appears once) instead of
    scattered into a positional array.
    """
    names = list(base)
    frozen = cut_lineage(df)  # every fit reads the stored rows instead of recomputing the features
    fold = lambda i: (frozen.where(F.col(fold_col) != i), frozen.where(F.col(fold_col) == i))
    jobs = [lambda i=i, n=n: on_cells(base[n]()).fit(fold(i)[0]) for i in range(k) for n in names]
    jobs += [lambda n=n: on_cells(base[n]()).fit(frozen) for n in names]
    models = at_once(jobs, parallelism)
    oof = None
    for i in range(k):
        part = StackingModel(dict(zip(names, models[i * len(names):])), None, names, task).base_features(fold(i)[1])
        oof = part if oof is None else oof.unionByName(part)
    oof = cut_lineage(oof)
    meta_in = VectorAssembler(inputCols=names, outputCol="__meta").transform(oof)
    if hasattr(meta, "setFeaturesCol"):
        meta.setFeaturesCol("__meta")
    meta.setLabelCol(label)
    meta_model = meta.fit(meta_in)
    full = dict(zip(names, models[k * len(names):]))
    return StackingModel(full, meta_model, names, task), oof.select(key, label, *names)


# ---------------------------------------------------------------- weighted average
def weighted_average_fit(df: DataFrame, estimators: dict):
    return {name: est.fit(df) for name, est in estimators.items()}


def weighted_average_predict(models: dict, df: DataFrame, key: str, weights: dict | None = None,
                             probability: bool = False) -> DataFrame:
    """Weighted mean of the models' predictions (or class-1 / max probabilities)."""
    from .ensembles import ensemble
    frames = {}
    for name, m in models.items():
        p = m.transform(df)
        p = positive_score(p, "__out") if probability else p.withColumn("__out", F.col("prediction"))
        frames[name] = p.select(key, F.col("__out").alias("prediction"))
    return ensemble(frames, key, weights=weights or {n: 1.0 for n in models})


# ---------------------------------------------------------------- tuning
def tune(estimator: Estimator, grid: dict, df: DataFrame, task: str, fold_col: str,
         metric: str | None = None, parallelism: int = 2):
    """Grid search with ``pyspark.ml.tuning.CrossValidator`` on a hash fold column.

    ``grid`` maps parameter name -> candidate values. Folds come from
    :mod:`splits` (``foldCol``), so the search is deterministic. Returns
    (best model, DataFrame(params, avg_metric)).
    """
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator as SparkCV
    from pyspark.ml.tuning import ParamGridBuilder

    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    maps = builder.build()
    if task == REGRESSION:
        ev = RegressionEvaluator(metricName=metric or "r2", labelCol=estimator.getLabelCol())
    else:
        ev = MulticlassClassificationEvaluator(metricName=metric or "accuracy",
                                               labelCol=estimator.getLabelCol())
    cv = SparkCV(estimator=estimator, estimatorParamMaps=maps, evaluator=ev,
                 foldCol=fold_col, parallelism=parallelism)
    model = cv.fit(df.withColumn(fold_col, F.col(fold_col).cast("int")))
    rows = [(str({p.name: v for p, v in m.items()}), float(a)) for m, a in zip(maps, model.avgMetrics)]
    spark = df.sparkSession
    return model.bestModel, spark.createDataFrame(rows, "params string, avg_metric double")


# ---------------------------------------------------------------- persistence
def save_model(model, path: str) -> None:
    """Store a fitted model of the catalogue, a composed one or a dict of models."""
    persistence.save(model, path)


def load_model(path: str):
    return persistence.load(path)


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


__all__ = ["CATALOGUE", "make_estimator", "train_models", "train_one", "cross_validate",
           "hybrid_fit", "stacking_fit", "weighted_average_fit", "weighted_average_predict",
           "tfidf_estimator", "GroupMeanRegressor", "assemble", "positive_score", "data_stats",
           "HasFeaturesCol"]
