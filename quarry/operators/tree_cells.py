"""Trees and boosted trees fitted on cells instead of rows.

MLlib's trees see a feature only by its bin (at most ``maxBins``), so rows that share all bins (and,
for classes, the label) can be added up first: one row per cell with its number of rows as the weight
and, for numbers, the mean label. A split's gain differs by nothing: the spread of labels inside a
cell is the same before and after a split, and the residuals of squared error are linear in the label.
Every row takes part; after the one pass that counts the cells, a fit costs what its cells cost, at
most the product of the bins, whatever the rows.

Bins are cut as MLlib cuts them: between the values of a feature, weighted by their rows, over a
bounded sample of ``max(maxBins ** 2, 10000)`` rows (all rows where there are fewer).

Models that draw rows for each tree (forests) are no such case, see ``forest_cells``; nor are
estimators with a weight column, sampled rows, categorical features or conditions on a node's number
of rows.
"""

from __future__ import annotations

import threading
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c
from ..session import cut_lineage
from .persistence import StoredModel

_CLASSES, _NUMBERS = (DecisionTreeClassifier, GBTClassifier), (DecisionTreeRegressor, GBTRegressor)
CELLS_A_TASK = 50_000
_MOST_BINS = 1024  # MLlib looks at the square of it in cells, to find the bins again


def cut_points(values: np.ndarray, bins: int) -> list[float]:
    """MLlib's thresholds of a continuous feature for these sampled values."""
    seen = sorted(Counter(values.tolist()).items())
    if len(seen) <= bins:
        return [(a[0] + b[0]) / 2 for a, b in zip(seen, seen[1:])]
    cuts, stride = [], len(values) / bins
    count, target = seen[0][1], stride
    for (low, _), (value, n) in zip(seen, seen[1:]):
        before, count = count, count + n
        if abs(before - target) < abs(count - target):
            cuts.append((low + value) / 2)
            target += stride
    return cuts


def _bin(x: Column, cuts: list[float], low: int = 0) -> Column:
    """Number of thresholds under ``x`` (a NaN is above all), by halving."""
    if not cuts:
        return F.lit(float(low))
    mid = len(cuts) // 2
    return F.when(x <= F.lit(cuts[mid]), _bin(x, cuts[:mid], low)).otherwise(_bin(x, cuts[mid + 1:], low + mid + 1))


def _default(est, names) -> bool:
    return all(not est.hasParam(p) or not est.isSet(p) or est.getOrDefault(p) == v for p, v in names.items())


def on_cells(est: Estimator, shared: SharedCells | None = None) -> Estimator:
    """``est`` fitted on cells where that gives the same trees, else ``est`` itself. ``shared`` keeps
    the cells of one frame for several estimators."""
    plain = {"subsamplingRate": 1.0, "minInstancesPerNode": 1, "minWeightFractionPerNode": 0.0, "featureSubsetStrategy": "all"}
    if type(est) not in (*_CLASSES, *_NUMBERS) or est.isSet("weightCol") or est.hasParam("validationIndicatorCol") \
            and est.isSet("validationIndicatorCol") or not _default(est, plain):
        return est
    if isinstance(est, GBTRegressor) and est.getLossType() != "squared":
        return est
    return CellTrees(est, shared)


@dataclass
class Cells:
    """The cells of ``n`` rows: the thresholds of each feature, and a stored row per cell (and class)
    with the bins ``b0``, ``b1``, .. as doubles, the label (of numbers the mean) and the number of rows."""
    n: int
    cuts: list
    table: DataFrame
    size: int

    def frame(self) -> DataFrame:
        places = [f"b{i}" for i in range(len(self.cuts))]
        few = self.table.coalesce(max(1, self.size // CELLS_A_TASK))  # each boosting pass has a task for each part
        return few.select(array_to_vector(F.array(*places)).alias("features"), "label", "weight")

    def max_bins(self, est: Estimator) -> int:
        """Enough that MLlib looks at all cells when it finds the bins again."""
        most = int(np.ceil(np.sqrt(max(self.size, 1))))
        return max(est.getMaxBins(), min(_MOST_BINS, most))


def make_cells(est: Estimator, df: DataFrame) -> Cells | None:
    """The cells of ``df`` for ``est``; None where there are no features to be cut."""
    col, label = est.getFeaturesCol(), est.getLabelCol()
    n = df.count()
    wanted = max(est.getMaxBins() ** 2, 10_000)
    part = df.sample(False, wanted / n, est.getSeed()) if n > wanted else df
    sample = np.array([r["x"] for r in part.select(vector_to_array(F.col(col)).alias("x")).collect()], dtype=np.float64)
    if sample.ndim != 2:
        return None
    bins = min(est.getMaxBins(), n)
    cuts = [cut_points(x, bins) for x in sample.T]
    places = [f"b{i}" for i in range(len(cuts))]
    # Numbers that MLlib refuses (NaN, infinities, missing labels) reach it as such.
    x = vector_to_array(F.col(col))
    rows = CellTreesModel(cuts, col, None).binned(df.withColumn("__x", x)).select(
        *[F.when(F.abs(F.col("__x")[i]) < F.lit(float("inf")), F.col("__bins")[i]).otherwise(F.lit(float("nan"))).alias(b)
          for i, b in enumerate(places)], c(label).cast("double").alias("label"))
    n_rows = F.count(F.lit(1))
    weight = n_rows.cast("double").alias("weight")
    cells = rows.groupBy(*places, "label").agg(weight) if isinstance(est, _CLASSES) else \
        rows.groupBy(*places).agg(weight, F.when(F.count("label") == n_rows, F.avg("label")).alias("label"))
    cells = cut_lineage(cells)
    return Cells(n, cuts, cells, cells.count())


class SharedCells:
    """Cells of one frame, made once for all estimators that would cut it alike."""

    def __init__(self, df: DataFrame):
        self.df, self.lock, self.made = df, threading.Lock(), {}

    def of(self, est: Estimator, df: DataFrame) -> Cells | None:
        if df is not self.df:
            return make_cells(est, df)
        key = (est.getFeaturesCol(), est.getLabelCol(), est.getMaxBins(), est.getSeed(), isinstance(est, _CLASSES))
        with self.lock:
            if key not in self.made:
                self.made[key] = make_cells(est, df)
            return self.made[key]


class CellTrees(Estimator):
    def __init__(self, inner: Estimator, shared: SharedCells | None = None):
        super().__init__()
        self.inner, self.shared = inner, shared

    def _fit(self, df: DataFrame) -> CellTreesModel:
        est, col = self.inner, self.inner.getFeaturesCol()
        cells = self.shared.of(est, df) if self.shared else make_cells(est, df)
        if cells is None:  # MLlib says what it misses
            return CellTreesModel([], col, est.fit(df))
        inner = est.copy({est.maxBins: cells.max_bins(est), est.weightCol: "weight", est.featuresCol: "features", est.labelCol: "label"})
        model = CellTreesModel(cells.cuts, col, inner.fit(cells.frame()))
        model.inner.setFeaturesCol("__vector")
        return model


class CellTreesModel(StoredModel):
    """The thresholds of each feature, and the trees over their numbers."""

    def __init__(self, cuts: list, features_col: str, inner: Model):
        super().__init__()
        self.cuts, self.features_col, self.inner = cuts, features_col, inner

    def state(self):
        return {"cuts": self.cuts, "features_col": self.features_col}, {}, {"inner": self.inner}

    @classmethod
    def from_state(cls, values, frames, models):
        return cls(inner=models["inner"], **values)

    def binned(self, df: DataFrame) -> DataFrame:
        """``df``, which has the features as the array ``__x``, with the bins as the array ``__bins``."""
        return df.withColumn("__bins", F.array(*[_bin(F.col("__x")[i], cuts) for i, cuts in enumerate(self.cuts)]))

    def _transform(self, df: DataFrame) -> DataFrame:
        if not self.cuts:
            return self.inner.transform(df)
        made = self.binned(df.withColumn("__x", vector_to_array(F.col(self.features_col))))
        made = made.withColumn("__vector", array_to_vector(F.col("__bins"))).drop("__x", "__bins")
        return self.inner.transform(made).drop("__vector")
