"""Forests of regression trees fitted on drawn cells instead of rows.

MLlib gives every row a Poisson(1) number of copies for each tree, keeps all these numbers with the
rows, and reads them again for every level of the trees. A tree needs less: its trees see a feature
only by its bin, so of a cell (the rows that share all bins, see ``tree_cells``) they use the number
of copies and the sum of their labels. Here one pass draws the copies of every row for every tree and
adds them up by cell; then each tree is one of MLlib's, fitted on its own cells with the copies as
weights and their mean labels. A split's gain, and so a tree, is that of the drawn rows.

Rows are dealt out by cell for that pass (the cells of many rows to several tasks); a task sorts its
rows, so that what it draws does not depend on the order in which they arrive.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c
from ..session import stored_rows
from .tree_cells import Cells, CellTreesModel, SharedCells, _default, make_cells

DRAWN_ROWS = 1 << 20  # rows for which a task draws
TOGETHER = 4096       # rows for which it draws at once: their numbers stay in a core's cache
FEWER_CELLS = 8       # rows a cell at least; else the cells of all trees are no less than the rows
MOST_THREADS = 16     # trees fitted at once, on as many cores
LOOKED_UP = 1 << 18   # possible cells whose predictions are made once and looked up


def forest_on_cells(est: Estimator, shared: SharedCells | None = None) -> Estimator:
    """``est`` fitted on drawn cells if it is a forest of regression trees that draws rows as MLlib
    does by default, else ``est`` itself."""
    plain = {"subsamplingRate": 1.0, "bootstrap": True, "minInstancesPerNode": 1, "minWeightFractionPerNode": 0.0}
    return CellForest(est, shared) if type(est) is RandomForestRegressor and not est.isSet("weightCol") and _default(est, plain) else est


def copies(rng: np.random.Generator, n: int, shares: list, table: np.ndarray) -> np.ndarray:
    """``n`` Poisson(1) numbers. 16 random bits tell most of them (``table``); the few that they leave
    open (-1) are told by more bits, so that the shares are exact to double precision."""
    u = rng.integers(0, 1 << 16, n, dtype=np.uint16)
    k = np.take(table, u)
    left = np.flatnonzero(k < 0)
    k[left] = np.searchsorted(shares, (u[left] + rng.random(len(left))) / (1 << 16), side="right")
    return k


def copies_table() -> tuple[np.ndarray, np.ndarray]:
    """The cumulated shares of 0, 1, .. copies, and the number that the first 16 bits tell."""
    shares = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(30)])
    edges = np.arange((1 << 16) + 1) / (1 << 16)
    low, high = np.searchsorted(shares, edges[:-1], side="right"), np.searchsorted(shares, edges[1:], side="left")
    return shares, np.where(low == high, low, -1).astype(np.int8)


def cell_sums(code: np.ndarray, y: np.ndarray, draw, together: int = TOGETHER):
    """(codes, copies, sums of labels) in turn for parts of the sorted rows, the last two with a column
    per tree; a code is given once. ``draw(n)`` gives the copies of the next ``n`` rows."""
    held = None
    for at in range(0, len(code), together):
        part, k = code[at:at + together], draw(len(code[at:at + together]))
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        codes, w = part[starts], np.add.reduceat(k, starts, axis=0, dtype=np.int64)
        s = np.add.reduceat(k * y[at:at + together, None], starts, axis=0)
        if held is not None and held[0][0] == codes[0]:
            w[0] += held[1][0]
            s[0] += held[2][0]
        elif held is not None:
            yield held
        if len(codes) > 1:
            yield codes[:-1], w[:-1], s[:-1]
        held = codes[-1:], w[-1:], s[-1:]
    if held is not None:
        yield held


def _code(bins: list[Column], sizes: list[int]) -> Column:
    code = F.lit(0).cast("bigint")
    for b, size in zip(bins, sizes):
        code = code * F.lit(size) + b.cast("bigint")
    return code


def _bins(code: str, sizes: list[int]) -> Column:
    """The vector of bins that the column ``code`` stands for."""
    bins, step = [], 1
    for size in reversed(sizes):
        bins.append(F.expr(f"({code} div {step}L) % {size}L").cast("double"))
        step *= size
    return array_to_vector(F.array(*reversed(bins)))


def drawn_cells(df: DataFrame, cells: Cells, col: str, label: str, trees: int, seed: int, rows_a_task: int = DRAWN_ROWS) -> DataFrame:
    """(tree, features, label, weight): for every tree the cells of its drawn rows."""
    sizes = [len(x) + 1 for x in cells.cuts]
    x = df.select(vector_to_array(F.col(col)).alias("__x"), c(label).cast("double").alias("label"))
    binned = CellTreesModel(cells.cuts, col, None).binned(x)
    rows = binned.select(_code([F.col("__bins")[i] for i in range(len(sizes))], sizes).alias("code"), "label")
    tasks = max(1, math.ceil(cells.n / rows_a_task))
    keys = ["code"]
    if tasks > 1:
        # At most ``tasks`` cells have more rows than a task's share.
        most = cells.n / tasks
        parts = cells.table.where(F.col("weight") > F.lit(most)).select(
            _code([F.col(f"b{i}") for i in range(len(sizes))], sizes).alias("code"), F.ceil(F.col("weight") / F.lit(most)).alias("parts"))
        rows = rows.join(F.broadcast(parts), "code", "left").select(
            "code", "label", F.coalesce(F.monotonically_increasing_id() % F.col("parts"), F.lit(0)).alias("part"))
        keys.append("part")

    def draw(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        got = [(b["code"].to_numpy(), b["label"].to_numpy()) for b in (pa.Table.from_batches([b]) for b in batches)]
        if not got:
            return
        code, y = (np.concatenate(x) for x in zip(*got))
        del got
        order = np.lexsort((y, code))
        shares, table = copies_table()
        rng = np.random.Generator(np.random.SFC64([seed % (1 << 64), TaskContext.get().partitionId()]))
        numbers = np.arange(trees, dtype=np.int32)
        for codes, w, s in cell_sums(code[order], y[order], lambda n: copies(rng, n * trees, shares, table).reshape(n, trees)):
            i, t = np.nonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[t]), pa.array(codes[i]), pa.array(s[i, t] / w[i, t]), pa.array(w[i, t].astype(np.float64))],
                                             names=["tree", "code", "label", "weight"])

    drawn = rows.repartition(tasks, *keys).select("code", "label").mapInArrow(draw, "tree int, code bigint, label double, weight double")
    return drawn.select("tree", _bins("code", sizes).alias("features"), "label", "weight")


class CellForest(Estimator):
    def __init__(self, inner: RandomForestRegressor, shared: SharedCells | None = None):
        super().__init__()
        self.inner, self.shared = inner, shared

    def _fit(self, df: DataFrame):
        est, col = self.inner, self.inner.getFeaturesCol()
        cells = self.shared.of(est, df) if self.shared else make_cells(est, df)
        if cells is None or cells.n < FEWER_CELLS * cells.size or math.prod(len(x) + 1 for x in cells.cuts) >= 1 << 63:
            return est.fit(df)
        finite = F.lit(True)
        for x in cells.table.columns:
            finite &= F.abs(F.col(x)) < F.lit(float("inf"))
        if not cells.table.where(~F.coalesce(finite, F.lit(False))).isEmpty():
            return est.fit(df)  # MLlib says what it refuses
        n = est.getNumTrees()
        drawn = drawn_cells(df, cells, col, est.getLabelCol(), n, est.getSeed()).repartition(n, "tree")
        with stored_rows(drawn, "drawn-cells", "tree") as drawn:
            model = CellForestModel(cells.cuts, col, _forest(est, cells, drawn))
        model.inner.setFeaturesCol("__vector")
        return model


class CellForestModel(CellTreesModel):
    """A row's prediction is that of its cell: a hundred trees go over the possible cells, not over the rows."""

    def _transform(self, df: DataFrame) -> DataFrame:
        sizes = [len(x) + 1 for x in self.cuts]
        if math.prod(sizes) > LOOKED_UP:
            return super()._transform(df)
        every = df.sparkSession.range(math.prod(sizes)).select(F.col("id").alias("__code"), _bins("id", sizes).alias("__vector"))
        known = self.inner.transform(every).drop("__vector")
        made = self.binned(df.withColumn("__x", vector_to_array(F.col(self.features_col))))
        made = made.withColumn("__code", _code([F.col("__bins")[i] for i in range(len(sizes))], sizes)).drop("__x", "__bins")
        return made.join(F.broadcast(known), "__code", "left").drop("__code")


def _forest(est: RandomForestRegressor, cells: Cells, drawn: DataFrame):
    """MLlib's forest of ``est``, its trees fitted one by one."""
    from .models import at_once

    spark, n, subset = drawn.sparkSession, est.getNumTrees(), est.getFeatureSubsetStrategy()
    rng = random.Random(est.getSeed())
    one = {est.numTrees: 1, est.bootstrap: False, est.weightCol: "weight", est.featuresCol: "features", est.labelCol: "label",
           est.maxBins: cells.max_bins(est), est.featureSubsetStrategy: ("onethird" if n > 1 else "all") if subset == "auto" else subset}

    def job(tree: int, seed: int):
        return lambda: est.copy({**one, est.seed: seed}).fit(drawn.where(F.col("tree") == tree).drop("tree"))

    fitted = at_once([job(t, rng.getrandbits(62)) for t in range(n)], min(MOST_THREADS, spark.sparkContext.defaultParallelism))
    kinds = spark._jvm.org.apache.spark.ml.regression
    trees = spark.sparkContext._gateway.new_array(kinds.DecisionTreeRegressionModel, n)
    for i, forest in enumerate(fitted):
        trees[i] = forest._java_obj.trees()[0]
    return est._copyValues(est._create_model(kinds.RandomForestRegressionModel(est.uid, trees, len(cells.cuts))))
