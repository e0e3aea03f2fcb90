"""Exact best split of every feature (the search of a decision tree's first node).

All features are searched in one pass: rows become (feature, value) with the label's sums, equal
values are added up, and prefix sums over the distinct values give the left side of every possible
split at once. A tree learner that bins values finds the same split where its bins hold every value,
so this is an independent check of the tree family, and exact where bins are coarser.

``gain`` is the fall of the label's variance (regression) or of the Gini impurity (classes), each
side weighted by its share of the rows. The threshold lies halfway between two distinct values that
follow each other; rows at or under it go left. Rows with a NULL label take no part; a feature's NULL
(or NaN) rows take no part in that feature's split. A feature with one value has no split and no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import c
from .ordering import IDX, prefix_sums, row_index

CLASSIFICATION = "classification"
REGRESSION = "regression"


def _long(df: DataFrame, features, stats: dict) -> DataFrame:
    """(feature, value, n, sums): one row per distinct value of a feature."""
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), c(x).cast("double").alias("value")) for i, x in enumerate(features)])
    rows = df.select(F.explode(pairs).alias("p"), *[e.alias(n) for n, e in stats.items()]).select("p.*", *stats)
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in stats])


def split_gains(df: DataFrame, features, label: str, task: str) -> DataFrame:
    """(feature, value, next_value, gain, n_left, n_right) of every split of every feature; ``feature``
    is the place in ``features``."""
    df = df.where(c(label).isNotNull())
    if task == REGRESSION:
        mean = df.agg(F.avg(c(label).cast("double"))).first()[0] or 0.0  # off before squares are compared
        stats = {"s": c(label).cast("double") - F.lit(mean)}
    elif task == CLASSIFICATION:
        classes = [r[0] for r in df.select(c(label)).distinct().orderBy(c(label)).collect()]  # one column each
        stats = {f"k{i}": F.when(c(label) == F.lit(v), 1).otherwise(0).cast("bigint") for i, v in enumerate(classes)}
    else:
        raise ValueError(task)
    cols = ["n", *stats]
    index = row_index(_long(df, features, stats), ["feature", "value"])
    run = prefix_sums(index, IDX, cols)
    # One row per feature: what comes before it in the running sums, and its own totals.
    ends = run.groupBy("feature").agg(F.max(IDX).alias("last"), *[F.sum(x).alias(f"t_{x}") for x in cols])
    order = Window.orderBy("feature").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as features
    ends = ends.select("*", *[F.coalesce(F.sum(f"t_{x}").over(order), F.lit(0)).alias(f"b_{x}") for x in cols])
    at = run.join(F.broadcast(ends), "feature").where(F.col(IDX) < F.col("last"))
    left = {x: F.col(f"{x}_cum") - F.col(f"b_{x}") for x in cols}
    right = {x: F.col(f"t_{x}") - left[x] for x in cols}
    part = lambda side: sum((side[x] * side[x] for x in stats), F.lit(0.0)) / side["n"]
    whole = sum((F.col(f"t_{x}") * F.col(f"t_{x}") for x in stats), F.lit(0.0)) / F.col("t_n")
    gain = (part(left) + part(right) - whole) / F.col("t_n")
    # The next distinct value is the next index of the same feature.
    follow = index.select((F.col(IDX) - 1).alias(IDX), F.col("value").alias("next_value"))
    return at.join(follow, IDX).select("feature", "value", "next_value", gain.alias("gain"),
                                       left["n"].cast("bigint").alias("n_left"), right["n"].cast("bigint").alias("n_right"))


def best_splits(df: DataFrame, features, label: str, task: str) -> DataFrame:
    """(feature, threshold, gain, n_left, n_right, rank): the best split of each feature, the least
    threshold on ties, ranked by gain and, on ties, by the feature's place."""
    features = list(features)
    gains = split_gains(df, features, label, task)
    inside = Window.partitionBy("feature").orderBy(F.col("gain").desc(), "value")
    best = gains.withColumn("__r", F.row_number().over(inside)).where("__r = 1")
    over = Window.orderBy(F.col("gain").desc(), "feature")  # one row per feature
    names = F.array(*[F.lit(x) for x in features])
    return best.select(F.element_at(names, F.col("feature") + 1).alias("feature"),
                       ((F.col("value") + F.col("next_value")) / 2).alias("threshold"), "gain", "n_left", "n_right",
                       F.row_number().over(over).alias("rank"))
