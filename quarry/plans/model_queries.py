"""Contract queries for models: closed-form checks, NB parameters, kNN, and the
fitted-model names checked by row count (M2, M5-M16)."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from ..functions.hashing import key_hash_sql
from ..operators import features as FE
from ..operators import isoforest as ISO
from ..operators import knn as KNN
from ..operators import models as MD
from ..operators import scoring as SC
from ..operators import splits as SP
from ..operators.tree_cells import on_cells
from ..session import stored_rows
from ..sources.scan import read_table
from .common import rnd, round_doubles
from .registry import register


def _lineitem_xy(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return MD.assemble(li.select("l_orderkey", "l_linenumber", "l_returnflag",
                                 F.col("l_quantity").alias("x"),
                                 F.col("l_extendedprice").alias("label")), ["x"])


def _coef_frame(spark, name, model, digits=4):
    raw = spark.createDataFrame([(name, float(model.coefficients[0]), float(model.intercept))],
                                "model string, slope double, intercept double")
    return round_doubles(raw, digits)


@register("linreg_one_feature", f"""
SELECT 'linear_regression' AS model, {rnd('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope,
       {rnd('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept FROM lineitem""")
def linreg_one_feature(spark, sf):
    df = _lineitem_xy(spark, sf)
    est = MD.make_estimator("linear_regression", MD.REGRESSION, MD.data_stats(df))
    return _coef_frame(spark, "linear_regression", est.fit(df))


@register("ridge_one_feature", f"""
WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) * count(*) AS sxy,
                  var_pop(l_quantity) * count(*) AS sxx, avg(l_quantity) AS mx,
                  avg(l_extendedprice) AS my FROM lineitem)
SELECT 'ridge_regression' AS model, {rnd('sxy / (sxx + 1.0)', 4)} AS slope,
       {rnd('my - sxy / (sxx + 1.0) * mx', 4)} AS intercept FROM s""")
def ridge_one_feature(spark, sf):
    df = _lineitem_xy(spark, sf)
    est = MD.make_estimator("ridge_regression", MD.REGRESSION, MD.data_stats(df))
    return _coef_frame(spark, "ridge_regression", est.fit(df))


@register("gaussian_nb_params", f"""
WITH n AS (SELECT count(*) AS n,
                  1e-9 * greatest(var_pop(value), var_pop(user_id)) AS eps FROM events)
SELECT event_type AS class, 'value' AS feature, {rnd('avg(value)')} AS mean,
       {rnd('var_pop(value) + any_value(n.eps)')} AS variance, {rnd('count(*) / any_value(n.n)')} AS prior
FROM events, n GROUP BY event_type
UNION ALL
SELECT event_type, 'user_id', {rnd('avg(user_id)')}, {rnd('var_pop(user_id) + any_value(n.eps)')},
       {rnd('count(*) / any_value(n.n)')} FROM events, n GROUP BY event_type""")
def gaussian_nb_params(spark, sf):
    ev = read_table(spark, sf, "events")
    indexer = StringIndexer(inputCol="event_type", outputCol="label", stringOrderType="alphabetAsc").fit(ev)
    df = MD.assemble(indexer.transform(ev), ["value", "user_id"])
    est = MD.make_estimator("gaussian_nb", MD.CLASSIFICATION, MD.data_stats(df, "label", MD.CLASSIFICATION))
    model = est.fit(df)
    theta, sigma, pi = model.theta.toArray(), model.sigma.toArray(), model.pi.toArray()
    rows = []
    import math
    for i, cls in enumerate(indexer.labels):
        for j, feat in enumerate(["value", "user_id"]):
            rows.append((cls, feat, float(theta[i][j]), float(sigma[i][j]), math.exp(float(pi[i]))))
    out = spark.createDataFrame(rows, "class string, feature string, mean double, variance double, prior double")
    return round_doubles(out)


H_EMB = key_hash_sql("vec_id")


@register("knn_vote", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, {H_EMB} % 1000 < 200 AS is_test
           FROM embeddings),
d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label, list_distance(q.v, t.v) AS dist
      FROM e q JOIN e t ON q.is_test AND NOT t.is_test),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d),
v AS (SELECT qid, label, count(*) AS votes FROM r WHERE rn <= 5 GROUP BY qid, label),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) AS bn FROM v)
SELECT qid AS vec_id, label AS predicted_label FROM b WHERE bn = 1""")
def knn_vote(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    split = SP.holdout(emb, "vec_id", 0.2)
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "valid")
    nb = KNN.neighbours(train, test, 5, "vec_id", "vec_id", "embedding", "label")
    return KNN.vote(nb).select(F.col("qid").alias("vec_id"), F.col("prediction").alias("predicted_label"))


@register("knn_mean", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, {H_EMB} % 1000 < 200 AS is_test
           FROM embeddings),
d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label, list_distance(q.v, t.v) AS dist
      FROM e q JOIN e t ON q.is_test AND NOT t.is_test),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d)
SELECT qid AS vec_id, {rnd('avg(CAST(label AS DOUBLE))')} AS prediction FROM r WHERE rn <= 5 GROUP BY qid""")
def knn_mean(spark, sf):
    """The catalogue's kNN regressor: mean label of the five nearest training vectors."""
    split = SP.holdout(read_table(spark, sf, "embeddings"), "vec_id", 0.2)
    train = split.where(F.col("split") == "train")
    est = MD.make_estimator("knn_regressor", MD.REGRESSION, MD.DataStats(1), "embedding", idCol="vec_id")
    out = est.fit(train).transform(split.where(F.col("split") == "valid"))
    return round_doubles(out.select("vec_id", "prediction"))


_MNB = ["l_quantity", "l_discount", "l_tax"]


def _mnb_sql(i: int, x: str) -> str:
    total = " + ".join(f"sum(CAST({y} AS DOUBLE))" for y in _MNB)
    return f"""SELECT l_returnflag AS class, '{x}' AS feature, {rnd(f'ln(sum(CAST({x} AS DOUBLE)) + 1) - ln({total} + {len(_MNB)})')} AS log_probability,
       {rnd('ln(count(*) + 1) - ln((SELECT count(*) + count(DISTINCT l_returnflag) FROM lineitem))')} AS log_prior FROM lineitem GROUP BY l_returnflag"""


@register("multinomial_nb_params", "\nUNION ALL\n".join(_mnb_sql(i, x) for i, x in enumerate(_MNB)))
def multinomial_nb_params(spark, sf):
    """Fitted parameters of the catalogue's multinomial naive Bayes, smoothing 1."""
    li = read_table(spark, sf, "lineitem")
    indexer = StringIndexer(inputCol="l_returnflag", outputCol="label", stringOrderType="alphabetAsc").fit(li)
    df = MD.assemble(indexer.transform(li), _MNB)
    model = MD.make_estimator("multinomial_nb", MD.CLASSIFICATION, MD.DataStats(1)).fit(df).inner
    theta, pi = model.theta.toArray(), model.pi.toArray()
    rows = [(cls, x, float(theta[i][j]), float(pi[i])) for i, cls in enumerate(indexer.labels) for j, x in enumerate(_MNB)]
    return round_doubles(spark.createDataFrame(rows, "class string, feature string, log_probability double, log_prior double"))


@register("hybrid_residual", f"""
WITH b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s,
                  regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem),
r AS (SELECT l.*, l_extendedprice - (b.i + b.s * l_quantity) AS resid, b.i + b.s * l_quantity AS base
      FROM lineitem l, b),
g AS (SELECT l_returnflag, avg(resid) AS m FROM r GROUP BY l_returnflag)
SELECT l_orderkey, l_linenumber, {rnd('base', 4)} AS base_prediction,
       {rnd('g.m', 4)} AS residual_prediction, {rnd('base + g.m', 4)} AS prediction
FROM r JOIN g USING (l_returnflag)""")
def hybrid_residual(spark, sf):
    df = _lineitem_xy(spark, sf)
    base = MD.make_estimator("linear_regression", MD.REGRESSION, MD.data_stats(df))
    model = MD.hybrid_fit(df, base, MD.GroupMeanRegressor(groupCol="l_returnflag"))
    out = model.transform(df)
    return round_doubles(out.select("l_orderkey", "l_linenumber", "base_prediction",
                                    "residual_prediction", "prediction"), 4)


# ---------------------------------------------------------------- rows-only names
def _lineitem_features(spark, sf):
    li = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus", "l_extendedprice")
    li = li.withColumn("key", F.xxhash64("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    fm = FE.fit(li, target="l_extendedprice", strategy="basic",
                exclude=("key", "l_orderkey", "l_linenumber"))
    t = fm.transform(li, keep=("key", "l_orderkey", "l_linenumber", "l_extendedprice"))
    feats = [x for x in fm.feature_names]
    return MD.assemble(t.withColumnRenamed("l_extendedprice", "label"), feats), feats


@register("model_ranking")
def model_ranking(spark, sf):
    """Train several regressors on an 80/20 hash split of lineitem and rank them by R^2."""
    df, _ = _lineitem_features(spark, sf)
    df = SP.holdout(df, "key").select("features", "label", "split")
    # Every fit and score reads the stored rows instead of making the features and the split again.
    with stored_rows(df, "model-ranking", "split", writers=2) as df:
        train, valid = df.where(F.col("split") == "train"), df.where(F.col("split") == "valid")
        run = MD.train_models(train, valid, ["linear_regression", "ridge_regression",
                                             "decision_tree_regressor", "random_forest_regressor",
                                             "gbt_regressor"], MD.REGRESSION,
                              # deeper than the catalogue's forest, which has MLlib's depth of 5
                              overrides={"random_forest_regressor": {"maxDepth": 8}})
        return run.rankings(spark)


def _documents(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text")


def _doc_labels(spark, sf):
    return read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))


@register("stacking_oof")
def stacking_oof(spark, sf):
    """5-fold out-of-fold stacking of two classifiers with a logistic meta model.

    Fitted on the labelled documents; every document gets the stacked prediction, and the
    labelled ones their out-of-fold predictions too."""
    docs = _documents(spark, sf).drop("text")
    d = docs.join(_doc_labels(spark, sf), "doc_id")
    fm = FE.fit(d, target="label", strategy="basic", exclude=("doc_id",))
    t = fm.transform(d, keep=("doc_id", "label"))
    df = SP.kfold(MD.assemble(t, fm.feature_names), "doc_id", 5)
    stats = MD.data_stats(df, "label", MD.CLASSIFICATION)
    base = {"lr": lambda: MD.make_estimator("logistic_regression", MD.CLASSIFICATION, stats),
            "dt": lambda: MD.make_estimator("decision_tree_classifier", MD.CLASSIFICATION, stats)}
    model, oof = MD.stacking_fit(df, base, LogisticRegression(), "fold", MD.CLASSIFICATION, "doc_id")
    whole = MD.assemble(fm.transform(docs, keep=("doc_id",)), fm.feature_names)
    final = model.transform(whole).select("doc_id", F.col("prediction").alias("stacked_prediction"))
    return final.join(oof, "doc_id", "left")


@register("tfidf_logistic_scores")
def tfidf_logistic_scores(spark, sf):
    """tf-idf + logistic regression on document text, fitted on the labelled documents; class-1
    probability of every document (null label where there is none)."""
    docs, labels = _documents(spark, sf).select("doc_id", "text"), _doc_labels(spark, sf)
    d = docs.join(labels, "doc_id")
    n = d.count()
    model = MD.tfidf_estimator("text", "label", "logistic", n=n).fit(d)
    out = MD.positive_score(model.transform(docs.join(labels, "doc_id", "left")))
    return out.select("doc_id", "label", "prediction", "score")


@register("gbt_scores")
def gbt_scores(spark, sf):
    """Gradient-boosted trees for l_returnflag = 'R' on lineitem, probability per row."""
    li = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        "l_linestatus", (F.col("l_returnflag") == "R").cast("double").alias("label"))
    fm = FE.fit(li, target="label", strategy="basic", exclude=("l_orderkey", "l_linenumber"))
    t = fm.transform(li, keep=("l_orderkey", "l_linenumber", "label"))
    df = MD.assemble(t, fm.feature_names)
    stats = MD.data_stats(df, "label", MD.CLASSIFICATION)
    est = on_cells(MD.make_estimator("gradient_boosting_classifier", MD.CLASSIFICATION, stats))
    out = MD.positive_score(est.fit(df).transform(df))
    return out.select("l_orderkey", "l_linenumber", "label", "prediction", "score")


@register("isolation_scores")
def isolation_scores(spark, sf):
    """Isolation forest (100 trees, 256-row subsamples) anomaly score per event."""
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "value")
    forest = ISO.fit(ev, ["user_id", "value"], "event_id", n_trees=100, max_samples=256)
    return ISO.score(ev, forest)


PATH_TREES, PATH_ROWS, PATH_SEED = 4, 64, 42


def _isolation_sql() -> str:
    """The forest level by level: rows of the samples and all events walk down the splits together."""
    depth = 6  # log2 of the rows a tree is grown on
    draw = lambda what: f"(('0x' || substr(md5('{PATH_SEED}:' || t || ':' || node || ':{what}'), 1, 8))::BIGINT / 4294967296.0)"
    c = lambda n: (f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 "  # noqa: E731
                   f"ELSE 2.0 * (ln({n} - 1) + 0.5772156649015329) - 2.0 * ({n} - 1) / {n} END")
    ctes = [f"""e AS (SELECT event_id, coalesce(CAST(user_id AS DOUBLE), (SELECT median(user_id) FROM events)) AS x0,
       coalesce(CAST(value AS DOUBLE), (SELECT median(value) FROM events)) AS x1, md5('{PATH_SEED}:' || event_id) AS d FROM events)""",
            f"""h AS (SELECT event_id, x0, x1, t, (('0x' || substr(d, 1, 12))::BIGINT + t * ('0x' || substr(d, 13, 12))::BIGINT) % {1 << 48} AS h
       FROM e, (SELECT unnest(range({PATH_TREES})) AS t))""",
            f"""r0 AS (SELECT t, 1::BIGINT AS node, x0, x1 FROM h QUALIFY row_number() OVER (PARTITION BY t ORDER BY h, event_id) <= {PATH_ROWS})""",
            "p0 AS (SELECT event_id, t, 1::BIGINT AS node, x0, x1 FROM h)"]
    for i in range(depth + 1):
        ctes.append(f"g{i} AS (SELECT t, node, count(*) AS n, min(x0) AS l0, max(x0) AS h0, min(x1) AS l1, max(x1) AS h1 FROM r{i} GROUP BY t, node)")
        if i < depth:
            ctes.append(f"""f{i} AS (SELECT *, CASE WHEN h0 > l0 AND h1 > l1 THEN CAST(floor({draw('feature')} * 2) AS INTEGER)
       WHEN h0 > l0 THEN 0 ELSE 1 END AS f, {draw('threshold')} AS u FROM g{i} WHERE n > 1 AND (h0 > l0 OR h1 > l1))""")
            ctes.append(f"""s{i} AS (SELECT * FROM (SELECT t, node, f, CASE WHEN f = 0 THEN l0 + u * (h0 - l0) ELSE l1 + u * (h1 - l1) END AS thr,
       CASE WHEN f = 0 THEN l0 ELSE l1 END AS low FROM f{i}) WHERE thr > low)""")
            down = "2 * node + CASE WHEN CASE WHEN f = 0 THEN x0 ELSE x1 END < thr THEN 0 ELSE 1 END AS node, x0, x1"
            ctes.append(f"r{i + 1} AS (SELECT t, {down} FROM r{i} JOIN s{i} USING (t, node))")
            ctes.append(f"p{i + 1} AS (SELECT event_id, t, {down} FROM p{i} JOIN s{i} USING (t, node))")
            ctes.append(f"q{i} AS (SELECT event_id, t, {i} + {c('n')} AS path FROM p{i} JOIN g{i} USING (t, node) ANTI JOIN s{i} USING (t, node))")
        else:
            ctes.append(f"q{i} AS (SELECT event_id, t, {i} + {c('n')} AS path FROM p{i} JOIN g{i} USING (t, node))")
    paths = " UNION ALL ".join(f"SELECT * FROM q{i}" for i in range(depth + 1))
    whole = f"least({PATH_ROWS}, (SELECT count(*) FROM events))"
    return f"""WITH {", ".join(ctes)}, a AS (SELECT event_id, sum(path) / {PATH_TREES} AS path FROM ({paths}) GROUP BY event_id)
SELECT event_id, {rnd('path')} AS mean_path, {rnd(f'pow(2.0, -path / ({c(whole)}))')} AS anomaly_score FROM a"""


@register("isolation_paths", _isolation_sql())
def isolation_paths(spark, sf):
    """Mean path length and score of every event in a small forest with hash-drawn splits."""
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "value")
    forest = ISO.fit(ev, ["user_id", "value"], "event_id", n_trees=PATH_TREES, max_samples=PATH_ROWS, seed=PATH_SEED)
    return round_doubles(ISO.score(ev, forest, path_out="mean_path").select("event_id", "mean_path", "anomaly_score"))


# ---------------------------------------------------------------- submission
def _submission(spark, sf, name="logistic_regression"):
    o = read_table(spark, sf, "orders")
    o = SP.holdout(o, "o_orderkey")
    indexer = StringIndexer(inputCol="o_orderstatus", outputCol="label",
                            stringOrderType="alphabetAsc").fit(o)
    feats = MD.assemble(indexer.transform(o), ["o_totalprice"])
    train = feats.where(F.col("split") == "train")
    test = feats.where(F.col("split") == "valid").drop("label", "o_orderstatus")
    stats = MD.data_stats(train, "label", MD.CLASSIFICATION)
    model = MD.make_estimator(name, MD.CLASSIFICATION, stats).fit(train)
    return SC.score(model, test.withColumnRenamed("o_orderkey", "id"), "o_orderstatus",
                    label_names=indexer.labels)


@register("submission")
def submission(spark, sf):
    """Score the 20 % hold-out of orders with a model fitted on the rest: (id, o_orderstatus)."""
    return _submission(spark, sf)


@register("submission_gaussian", f"""
WITH o AS (SELECT o_orderkey, o_orderstatus AS k, CAST(o_totalprice AS DOUBLE) AS x, {key_hash_sql('o_orderkey')} % 1000 < 200 AS is_test FROM orders),
e AS (SELECT 1e-9 * var_pop(x) AS eps, count(*) AS n FROM o WHERE NOT is_test),
c AS (SELECT k, avg(x) AS m, var_pop(x) + any_value(eps) AS v, ln(count(*) / any_value(n)) AS p FROM o, e WHERE NOT is_test GROUP BY k),
s AS (SELECT o_orderkey, c.k, p - 0.5 * ln(2 * pi() * v) - (x - m) ** 2 / (2 * v) AS score FROM o, c WHERE is_test)
SELECT o_orderkey AS id, k AS o_orderstatus FROM s QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, k) = 1""")
def submission_gaussian(spark, sf):
    """Submission of a closed-form model: Gaussian naive Bayes on the price, for the hold-out orders."""
    return _submission(spark, sf, "gaussian_nb")


@register("submission_validation", f"""
SELECT count(*) AS n_rows, 2 AS n_columns, CAST(0 AS BIGINT) AS n_null_cells, TRUE AS is_valid,
       '' AS issues
FROM orders WHERE {key_hash_sql('o_orderkey')} % 1000 < 200""")
def submission_validation(spark, sf):
    return SC.validate(_submission(spark, sf))

