"""Contract queries over stored predictions: versions evaluated and combined."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.hashing import key_hash_sql
from ..operators import features as FE
from ..operators import models as MD
from ..operators import prediction_store as PS
from ..operators import splits as SP
from ..session import ensure_checkpoint_dir
from ..sources.scan import read_table, read_text_lines
from . import feature_queries as FQ
from . import model_queries as MQ
from .common import rnd, round_doubles
from .registry import ORACLES, register


def _trained(spark, sf):
    """A store with two versions trained on 80 % of the orders of ``lineitem`` and their predictions
    of the rest: v1 a line of an order's price on its quantity, v2 the mean price by least return flag."""
    li = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("bigint").alias("key")).agg(
        F.min("l_returnflag").alias("l_returnflag"), F.sum(F.col("l_quantity").cast("double")).alias("x"),
        F.sum(F.col("l_extendedprice").cast("double")).alias("label"))
    df = SP.holdout(MD.assemble(li, ["x"]), "key")
    train, valid = df.where(F.col("split") == "train"), df.where(F.col("split") == "valid")
    store = PS.PredictionStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    line = MD.make_estimator("linear_regression", MD.REGRESSION, MD.data_stats(train))
    for version, fits in (("v1", {"line": line}), ("v2", {"flag_mean": MD.GroupMeanRegressor(groupCol="l_returnflag")})):
        run = MD.MultiModelRun()
        for name, est in fits.items():
            model = est.fit(train)
            pred = model.transform(valid)
            run.results.append(MD.TrainResult(name, MD.score_predictions(pred, MD.REGRESSION, "r2"), "r2", 0.0, model, predictions=pred))
        store.write_training(version, MD.REGRESSION, run, valid, "key")
    return store


_STORED_SQL = f"""
l AS (SELECT CAST(l_orderkey AS BIGINT) AS key, min(l_returnflag) AS l_returnflag, sum(CAST(l_quantity AS DOUBLE)) AS x,
             sum(CAST(l_extendedprice AS DOUBLE)) AS y FROM lineitem GROUP BY l_orderkey),
s AS (SELECT *, {key_hash_sql('key')} % 1000 < 200 AS is_valid FROM l),
b AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS base, avg(y) AS mean FROM s WHERE NOT is_valid),
g AS (SELECT l_returnflag, avg(y) AS m FROM s WHERE NOT is_valid GROUP BY l_returnflag),
p AS (SELECT key, y, base + slope * x AS v1, coalesce(g.m, b.mean) AS v2 FROM s CROSS JOIN b LEFT JOIN g USING (l_returnflag) WHERE is_valid),
r AS (SELECT 1 - avg((y - v1) ** 2) / var_pop(y) AS r1, 1 - avg((y - v2) ** 2) / var_pop(y) AS r2 FROM p)"""


def _version_sql(version: str, model: str) -> str:
    err = f"(y - {version})"
    return f"""SELECT '{version}' AS version, '{model}' AS model, count(*) AS n, {rnd(f'avg({err} ** 2)', 3)} AS mse,
       {rnd(f'sqrt(avg({err} ** 2))', 3)} AS rmse, {rnd(f'avg(abs({err}))', 3)} AS mae,
       {rnd(f'1 - avg({err} ** 2) / var_pop(y)')} AS r2 FROM p"""


@register("evaluate_version", f"WITH {_STORED_SQL}\n{_version_sql('v1', 'line')}\nUNION ALL\n{_version_sql('v2', 'flag_mean')}")
def evaluate_version(spark, sf):
    """Metrics of the best model of each stored version, labels and predictions joined by bucket."""
    store, out = _trained(spark, sf), None
    for version in ("v1", "v2"):
        found = PS.evaluate_version(store, version)
        part = found["metrics"].select(F.lit(version).alias("version"), F.lit(found["model"]).alias("model"), "n",
                                       *[F.round(x, 3).alias(x) for x in ("mse", "rmse", "mae")], F.round("r2", 6).alias("r2"))
        out = part if out is None else out.unionByName(part)
    return out


@register("ensemble_stored", f"""WITH {_STORED_SQL}
SELECT key, 'average' AS method, {rnd('(v1 + v2) / 2', 3)} AS prediction, CAST(2 AS BIGINT) AS n_models FROM p
UNION ALL
SELECT key, 'given', {rnd('(3 * v1 + v2) / 4', 3)}, CAST(2 AS BIGINT) FROM p
UNION ALL
SELECT key, 'weighted', {rnd('(r1 * v1 + r2 * v2) / (r1 + r2)', 3)}, CAST(2 AS BIGINT) FROM p CROSS JOIN r""")
def ensemble_stored(spark, sf):
    """Two stored versions combined: evenly, by given weights and by their scores."""
    store, versions = _trained(spark, sf), ["v1", "v2"]
    frames = {"average": PS.ensemble_versions(store, versions), "given": PS.ensemble_versions(store, versions, weights=[3.0, 1.0]),
              "weighted": PS.ensemble_versions(store, versions, "weighted")}
    out = None
    for method, rows in frames.items():
        part = rows.select("key", F.lit(method).alias("method"), "prediction", "n_models")
        out = part if out is None else out.unionByName(part)
    return round_doubles(out, 3)


def _place(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("feat_state_stored", FQ._impute_scale_sql())
def feat_state_stored(spark, sf):
    """Imputed and scaled numbers by feature state that was stored and loaded."""
    df = FQ._keyed_events(spark, sf)
    path = _place(spark, "features")
    FE.fit(df, strategy="basic", exclude=("key", *FQ.EV_CAT)).save(path)
    model = FE.FeatureModel.load(spark, path)
    return round_doubles(model.transform(df, keep=("key",)).select("key", *FQ.EV_NUM))


@register("model_stored", ORACLES["hybrid_residual"])
def model_stored(spark, sf):
    """Predictions of a hybrid model that was stored and loaded."""
    df = MQ._lineitem_xy(spark, sf)
    base = MD.make_estimator("linear_regression", MD.REGRESSION, MD.data_stats(df))
    path = _place(spark, "hybrid")
    MD.save_model(MD.hybrid_fit(df, base, MD.GroupMeanRegressor(groupCol="l_returnflag")), path)
    out = MD.load_model(path).transform(df)
    return round_doubles(out.select("l_orderkey", "l_linenumber", "base_prediction", "residual_prediction", "prediction"), 4)


@register("text_lines_stored", """
SELECT md5(line) AS line_md5, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
GROUP BY line""")
def text_lines_stored(spark, sf):
    """Lines of the documents, written as text files and read again (S3)."""
    path = _place(spark, "lines")
    read_table(spark, sf, "documents").where("text is not null").select("text").write.text(path)
    return read_text_lines(spark, path).groupBy("text").count().select(F.md5("text").alias("line_md5"), F.col("count").alias("n"))
