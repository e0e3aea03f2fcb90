"""Contract queries for evaluation metrics and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import key_hash_sql
from ..operators import ensembles as EN
from ..operators import metrics as M
from ..operators import splits as SP
from .common import rnd, round_doubles
from .fixtures import (ORDER_STATUS_SQL, PRICE_SQL, QUALITY_SQL, order_status_predictions,
                       price_predictions, quality_scores)
from .registry import register


def _per_class_sql(src):
    return f"""
WITH cm AS (SELECT label, prediction, count(*) AS count FROM {src} GROUP BY ALL),
r AS (SELECT CAST(label AS VARCHAR) AS class, count AS support, 0 AS predicted,
             CASE WHEN label = prediction THEN count ELSE 0 END AS tp FROM cm
      UNION ALL
      SELECT CAST(prediction AS VARCHAR), 0, count, 0 FROM cm),
pc AS (SELECT class, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM r GROUP BY class),
m AS (SELECT *, coalesce(tp * 1.0 / nullif(predicted, 0), 0) AS p, coalesce(tp * 1.0 / nullif(support, 0), 0) AS r
      FROM pc)"""


@register("clf_metrics", _per_class_sql(ORDER_STATUS_SQL) + f"""
SELECT CAST(sum(support) AS BIGINT) AS n, {rnd('sum(tp) / sum(support)')} AS accuracy,
       {rnd('sum(support * p) / sum(support)')} AS precision,
       {rnd('sum(support * r) / sum(support)')} AS recall,
       {rnd('sum(support * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(support)')} AS f1
FROM m""")
def clf_metrics(spark, sf):
    return round_doubles(M.classification_metrics(order_status_predictions(spark, sf)))


@register("clf_confusion", f"""
SELECT label, prediction, count(*) AS count FROM {ORDER_STATUS_SQL} GROUP BY ALL""")
def clf_confusion(spark, sf):
    return M.confusion(order_status_predictions(spark, sf))


@register("clf_auc", f"""
WITH s AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                  sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg
           FROM {QUALITY_SQL} WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY score),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS below FROM s)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
       {rnd('sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg))')} AS auc
FROM c""")
def clf_auc(spark, sf):
    return round_doubles(M.roc_auc(quality_scores(spark, sf)))


@register("reg_metrics", f"""
SELECT count(*) AS n, {rnd('avg((label - p_priority) ** 2)')} AS mse,
       {rnd('sqrt(avg((label - p_priority) ** 2))')} AS rmse,
       {rnd('avg(abs(label - p_priority))')} AS mae,
       {rnd('1 - avg((label - p_priority) ** 2) / nullif(var_pop(label), 0)')} AS r2
FROM {PRICE_SQL} WHERE label IS NOT NULL AND p_priority IS NOT NULL""")
def reg_metrics(spark, sf):
    p = price_predictions(spark, sf)
    return round_doubles(M.regression_metrics(p, "label", "p_priority"))


@register("error_rows", f"""
WITH p AS {ORDER_STATUS_SQL},
t AS (SELECT count(*) FILTER (WHERE label IS DISTINCT FROM prediction) AS e, count(*) AS n FROM p)
SELECT o_orderkey, label, prediction, CAST(t.e AS BIGINT) AS n_errors, t.e * 1.0 / t.n AS error_rate
FROM p, t WHERE label IS DISTINCT FROM prediction ORDER BY o_orderkey LIMIT 100""")
def error_rows(spark, sf):
    return M.error_rows(order_status_predictions(spark, sf), "o_orderkey")


@register("cv_summary", f"""
WITH f AS (SELECT CAST({key_hash_sql('o_orderkey')} % 5 AS INTEGER) AS fold,
                  avg(CASE WHEN label IS NOT DISTINCT FROM prediction THEN 1.0 ELSE 0.0 END) AS score
           FROM {ORDER_STATUS_SQL} GROUP BY 1)
SELECT {rnd('avg(score)')} AS mean_score, {rnd('stddev_pop(score)')} AS std_score,
       count(score) AS n_folds FROM f""")
def cv_summary(spark, sf):
    pred = SP.kfold(order_status_predictions(spark, sf), "o_orderkey", 5)
    return round_doubles(M.cv_summary(M.fold_scores(pred, "fold")))


ENSEMBLE_MODELS = ["p_priority", "p_bucket", "p_customer"]
ENSEMBLE_WEIGHTS = {"p_priority": 0.2, "p_bucket": 0.5, "p_customer": 0.3}


def _frames(spark, sf):
    p = price_predictions(spark, sf)
    return {m: p.select("o_orderkey", F.col(m).alias("prediction")) for m in ENSEMBLE_MODELS}


@register("ensemble_average", f"""
SELECT o_orderkey AS key, {rnd('(p_priority + p_bucket + p_customer) / 3.0')} AS prediction,
       CAST(3 AS BIGINT) AS n_models FROM {PRICE_SQL}""")
def ensemble_average(spark, sf):
    return round_doubles(EN.ensemble(_frames(spark, sf), "o_orderkey", "average"))


@register("ensemble_weighted", f"""
SELECT o_orderkey AS key,
       {rnd('(0.2 * p_priority + 0.5 * p_bucket + 0.3 * p_customer) / (0.2 + 0.5 + 0.3)')} AS prediction,
       CAST(3 AS BIGINT) AS n_models FROM {PRICE_SQL}""")
def ensemble_weighted(spark, sf):
    return round_doubles(EN.ensemble(_frames(spark, sf), "o_orderkey", weights=ENSEMBLE_WEIGHTS))
