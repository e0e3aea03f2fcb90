"""Model evaluation over prediction frames.

A prediction frame has one row per scored row: a key, the true label and the
prediction (and optionally a score). Every metric is an aggregation; the
confusion frame is at most classes x classes rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c
from .ordering import IDX, prefix_sums, row_index


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, count) (A30); the prediction takes the label's type."""
    lt = pred.schema[label].dataType
    return (pred.groupBy(c(label).alias("label"), c(prediction).cast(lt).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("count")))


def per_class(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, support, predicted, tp, precision, recall, f1); 0 for an empty class."""
    cm = confusion(pred, label, prediction)
    rows = cm.select(F.explode(F.array(
        F.struct(F.col("label").cast("string").alias("class"), F.col("count").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)
                 .cast("bigint").alias("tp")),
        F.struct(F.col("prediction").cast("string").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("count").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))).alias("r")
    ).select("r.*")
    agg = rows.groupBy("class").agg(F.sum("support").alias("support"),
                                    F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    agg = agg.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(0.0)
    return agg.withColumn("f1", f1)


def classification_metrics(pred: DataFrame, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """n, accuracy, support-weighted precision / recall / F1."""
    pc = per_class(pred, label, prediction)
    return pc.agg(
        F.sum("support").cast("bigint").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("support") * F.col("precision")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("support") * F.col("recall")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("support") * F.col("f1")) / F.sum("support")).alias("f1"))


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score",
            positive=1) -> DataFrame:
    """Area under the ROC curve of ``score`` for class ``positive``.

    AUC = (sum over positives of #negatives scored lower + half the negatives
    with an equal score) / (P * N): tied scores count one half, as average
    ranks do. Rows are first collapsed to one row per distinct score; the
    running negative count over scores uses blocked prefix sums.
    """
    is_pos = (c(label) == F.lit(positive)).cast("bigint")
    by_score = (pred.where(c(score).isNotNull() & c(label).isNotNull())
                .groupBy(c(score).cast("double").alias("s"))
                .agg(F.sum(is_pos).alias("pos"), F.sum(1 - is_pos).alias("neg")))
    ix = row_index(by_score, ["s"])
    cum = prefix_sums(ix, IDX, ["neg"])
    below = F.col("neg_cum") - F.col("neg")
    num = F.sum(F.col("pos") * (below + F.col("neg") * 0.5))
    return cum.agg(F.sum("pos").cast("bigint").alias("n_pos"), F.sum("neg").cast("bigint").alias("n_neg"),
                   F.try_divide(num, F.sum("pos") * F.sum("neg")).alias("auc"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """n, MSE, RMSE, MAE and R^2 = 1 - SSE / SST (A31); one aggregation."""
    y, p = c(label).cast("double"), c(prediction).cast("double")
    err = y - p
    agg = pred.where(y.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        F.var_pop(y).alias("__vy"))
    return agg.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae",
                      (1 - F.try_divide(F.col("mse"), F.nullif(F.col("__vy"), F.lit(0.0)))).alias("r2"))


def error_rows(pred: DataFrame, key: str, label: str = "label", prediction: str = "prediction",
               k: int = 100) -> DataFrame:
    """The first ``k`` misclassified rows by key, with the total error count and
    rate attached (A33, P8, K4)."""
    wrong = ~c(label).eqNullSafe(c(prediction))
    totals = pred.agg(F.count_if(wrong).alias("n_errors"), F.count(F.lit(1)).alias("n")).first()
    rate = totals["n_errors"] / totals["n"] if totals["n"] else None
    first = pred.where(wrong).orderBy(c(key)).limit(k)
    return first.select(c(key), c(label), c(prediction),
                        F.lit(totals["n_errors"]).cast("bigint").alias("n_errors"),
                        F.lit(rate).cast("double").alias("error_rate"))


def fold_scores(pred: DataFrame, fold: str = "fold", label: str = "label",
                prediction: str = "prediction", metric: str = "accuracy") -> DataFrame:
    """(fold, score) per fold: accuracy, or negated MSE for regression (M10 default)."""
    if metric == "accuracy":
        s = F.avg(c(label).eqNullSafe(c(prediction)).cast("double"))
    elif metric == "neg_mse":
        e = c(label).cast("double") - c(prediction).cast("double")
        s = -F.avg(e * e)
    else:
        raise ValueError(metric)
    return pred.groupBy(c(fold).alias("fold")).agg(s.alias("score"))


def cv_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """mean, population std and number of folds of per-fold scores."""
    return scores.agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"),
                      F.count(score).alias("n_folds"))


def custom_metric(pred: DataFrame, fn) -> DataFrame:
    """User metric (X1): ``fn(label_col, prediction_col) -> aggregate Column``."""
    return pred.agg(fn(F.col("label"), F.col("prediction")).alias("score"))
