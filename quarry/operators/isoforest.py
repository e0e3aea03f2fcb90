"""Isolation forest (M2 isolation_forest): anomaly scores for every row.

Fit: every tree takes the ``max_samples`` rows with the lowest hashes of (tree,
key) out of all rows; one md5 of the key gives a row's hashes for all trees. A row is offered to a tree only if that hash is under a
threshold that far more than ``max_samples`` rows meet (tested in the scan, before
any row is copied), then one ``row_number() <= max_samples`` per tree, with a
partial group limit before the shuffle, takes the lowest. Splits are drawn by hashes of (tree, node), so a forest depends on its rows alone,
not on partitions or the order of rows, and any engine can grow it again. The tree
grows in a grouped ``applyInPandas`` task (one task per tree). Trees are small
(< 2 * max_samples nodes), so the forest is broadcast.
Score: ``mapInPandas`` walks every tree for each Arrow batch; score =
2 ** (-mean path length / c(max_samples)).
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c
from .persistence import StoredModel, frame_of_trees, trees_of_frame
from .quantiles import quantiles


HASHES = 1 << 48  # a tree's hash of a row: (a + tree * b) mod HASHES, a and b from the md5 of the row's key

ROWS_TOGETHER = 4096  # rows that walk down a tree at once: their arrays stay in a core's cache


def _number(x: str):
    """A column as double; NaN and infinities count as missing."""
    v = c(x).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def _c(n: float) -> float:
    """Average path length of an unsuccessful search in a binary search tree."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def draw(seed: int, tree: int, node: int, what: str) -> float:
    """A number in [0, 1) from the md5 of its place in the forest: the same in any engine."""
    return int(hashlib.md5(f"{seed}:{tree}:{node}:{what}".encode()).hexdigest()[:8], 16) / 4294967296.0


def _grow(x: np.ndarray, seed: int, tree: int, limit: int):
    """Array-encoded tree: feature, threshold, left, right, size (leaf when feature < 0).

    Node 1 is the root, nodes 2i and 2i + 1 are the children of node i. A node with rows that differ,
    above the depth limit, splits on the feature (among those with two values or more, by place) that
    its first draw picks, at the part of the feature's span that its second draw gives; rows under
    the threshold go left."""
    feat, thr, left, right, size = [], [], [], [], []

    def grow(rows, depth, number):
        i = len(feat)
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(len(rows))
        if depth >= limit or len(rows) <= 1:
            return i
        sub = x[rows]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            return i
        f = int(cand[int(draw(seed, tree, number, "feature") * cand.size)])
        t = float(lo[f] + draw(seed, tree, number, "threshold") * (hi[f] - lo[f]))
        mask = sub[:, f] < t
        if not mask.any():  # the threshold fell on the least value
            return i
        feat[i], thr[i] = f, t
        left[i] = grow(rows[mask], depth + 1, 2 * number)
        right[i] = grow(rows[~mask], depth + 1, 2 * number + 1)
        return i

    grow(np.arange(len(x)), 0, 1)
    return {"f": feat, "t": thr, "l": left, "r": right, "s": size}


def _flat(tree) -> tuple:
    """(feature, threshold, children, path length at a leaf, steps): a leaf is its own child, so every
    row takes the same number of steps and none has to be looked at on the way."""
    f, t, left, right, size = (np.asarray(tree[k]) for k in ("f", "t", "l", "r", "s"))
    leaf = f < 0
    own = np.arange(len(f))
    depth = np.zeros(len(f), dtype=np.int64)
    for i in range(len(f)):  # children come after their parent
        if not leaf[i]:
            depth[left[i]] = depth[right[i]] = depth[i] + 1
    kids = np.stack([np.where(leaf, own, left), np.where(leaf, own, right)], axis=1).astype(np.intp).ravel()
    path = depth.astype(np.float64) + np.array([_c(v) for v in size])
    return np.where(leaf, 0, f).astype(np.intp), t.astype(np.float64), kids, path, int(depth.max())


def _path_lengths(tree, x: np.ndarray) -> np.ndarray:
    """Path lengths of the rows of ``x`` in a tree as :func:`_flat` gives it."""
    f, t, kids, path, steps = tree
    node = np.zeros(len(x), dtype=np.intp)
    values, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    for _ in range(steps):
        node = kids.take(2 * node + (values.take(first + f.take(node)) >= t.take(node)))
    return path.take(node)


def fit(df: DataFrame, feature_cols, key: str, n_trees: int = 100, max_samples: int = 256,
        seed: int = 42) -> dict:
    """Grow ``n_trees`` trees; returns the forest (a small dict). A missing value counts as the
    column's median, in fitting and in scoring."""
    cols = list(feature_cols)
    n = df.count()
    m = min(max_samples, n)
    limit = int(math.ceil(math.log2(max(m, 2))))
    medians = {x: v[0] for x, v in quantiles(df.select(*[c(x) for x in cols]), cols, [0.5]).items()}
    base = df.select(c(key).alias("__key"), *[F.coalesce(_number(x), F.lit(medians[x] or 0.0)).alias(x) for x in cols])
    # The m lowest hashes of n are all under (m + 12 * sqrt(m) + 60) / n but for a chance below 1e-30.
    share = min(1.0, (m + 12 * math.sqrt(m) + 60) / max(n, 1))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("__key").cast("string")))
    base = base.withColumn("__a", F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")) \
        .withColumn("__b", F.conv(F.substring(digest, 13, 12), 16, 10).cast("bigint"))
    bound = int(share * HASHES)
    kept = [x for x in base.columns if x not in ("__a", "__b")]
    fields = [base.schema[x] for x in kept] + [T.StructField("tree", T.IntegerType()), T.StructField("h", T.LongType())]

    def offered(batches):
        import pyarrow as pa

        trees = np.arange(n_trees)
        for batch in batches:
            batch = batch.filter(batch.column("__a").is_valid())  # without a key there is no hash
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                a, b = (part.column(x).to_numpy() for x in ("__a", "__b"))
                h = (a[:, None] + trees * b[:, None]) % HASHES
                row, tree = np.nonzero(h <= bound)
                found = part.select(kept).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array(tree, pa.int32()), pa.array(h[row, tree])],
                                                 names=[*kept, "tree", "h"])

    cand = base.mapInArrow(offered, T.StructType(fields))
    w = Window.partitionBy("tree").orderBy("h", F.col("__key"))
    sample = cand.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= m)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("__key")
        x = pdf[cols].to_numpy(dtype=np.float64)
        return pd.DataFrame({"tree": [tree_id], "model": [json.dumps(_grow(x, seed, tree_id, limit))]})

    grown = sample.groupBy("tree").applyInPandas(grow, "tree int, model string").collect()
    return {"cols": cols, "m": m, "medians": medians, "trees": [json.loads(r["model"]) for r in sorted(grown, key=lambda r: r["tree"])]}


def score(df: DataFrame, forest: dict, out: str = "anomaly_score", path_out: str | None = None) -> DataFrame:
    """Adds ``out`` in (0, 1]; higher is more anomalous. ``path_out``, if named, gets the mean path length."""
    cols, trees, cm = forest["cols"], forest["trees"], _c(forest["m"])
    bc = df.sparkSession.sparkContext.broadcast([_flat(t) for t in trees])
    added = [out] + ([path_out] if path_out else [])
    schema = T.StructType(list(df.schema.fields) + [T.StructField(x, T.DoubleType()) for x in added])

    fill = np.array([forest["medians"].get(x) or 0.0 for x in cols])

    def run(batches):
        ts = bc.value
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=np.float64)
            x = np.where(np.isfinite(x), x, fill)
            if len(x) == 0:
                yield pdf.assign(**{x: pd.Series([], dtype="float64") for x in added})
                continue
            total = np.zeros(len(x))
            for i in range(0, len(x), ROWS_TOGETHER):
                part = slice(i, i + ROWS_TOGETHER)
                for t in ts:
                    total[part] += _path_lengths(t, x[part])
            pdf[out] = np.power(2.0, -(total / len(ts)) / cm) if cm > 0 else 0.5
            if path_out:
                pdf[path_out] = total / len(ts)
            yield pdf

    return df.mapInPandas(run, schema)


class IsolationForestEstimator:
    """Catalogue wrapper: ``fit(df)`` grows the forest, the model's ``transform``
    adds ``anomaly_score`` (no label is used)."""

    def __init__(self, featureCols=None, keyCol: str = "id", n_trees: int = 100,
                 max_samples: int = 256, seed: int = 42):
        self.feature_cols, self.key_col = featureCols, keyCol
        self.n_trees, self.max_samples, self.seed = n_trees, max_samples, seed

    def fit(self, df: DataFrame):
        from ..functions.columns import numeric_columns
        cols = self.feature_cols or numeric_columns(df, (self.key_col,))
        return IsolationForestModel(fit(df, cols, self.key_col, self.n_trees, self.max_samples, self.seed))


class IsolationForestModel(StoredModel):
    """A grown forest; stored as one row per node."""

    def __init__(self, forest: dict):
        super().__init__()
        self.forest = forest

    def state(self):
        spark = SparkSession.active()
        plain = {k: v for k, v in self.forest.items() if k != "trees"}
        return plain, {"trees": frame_of_trees(spark, self.forest["trees"])}, {}

    @classmethod
    def from_state(cls, values, frames, models):
        return cls({**values, "trees": trees_of_frame(frames["trees"])})

    def _transform(self, df: DataFrame) -> DataFrame:
        return score(df, self.forest)
