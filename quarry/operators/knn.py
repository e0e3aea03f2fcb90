"""Exact k-nearest-neighbour classification / regression (M2 knn_*).

Two exact methods; neither materialises query-training pairs as rows, nor
sends data through the driver:

* ``blocks`` - a block nested loop: training rows get a block ``tb`` (hash of
  id mod T), query rows a block ``qb``; each (tb, qb) meets in one ``cogroup``
  group, a matrix product in chunks leaves out the pairs that cannot be
  among the nearest, the others get their exact distance, and only the k nearest
  per query are emitted (ties by training id). Work is O(train x queries).
* ``pivots`` - the same groups, but a query only meets the training cells
  that can hold one of its neighbours (triangle-inequality bound against
  pivots that are themselves training rows), so the work shrinks with data
  locality while staying exact. Used for large training sets.

One ``row_number() <= k`` per query merges the partial lists, then a vote
(most neighbours, smallest label on ties) or the mean label.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import c
from ..functions.hashing import key_hash
from .persistence import StoredModel

CLASSIFICATION = "classification"
REGRESSION = "regression"
CHUNK_BYTES = 32 << 20  # of the arrays that a task makes at once, beside the rows of its group


def _block(df: DataFrame, key: str, rows: int, out: str, seed: int):
    n = df.count()
    blocks = max(1, math.ceil(n / rows))
    return df.withColumn(out, (key_hash(c(key), seed) % blocks).cast("int")), blocks


def _exact(qv: np.ndarray, tv: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Distances of pairs (row of qv, row of tv), a bounded number of them at a time."""
    out = np.empty(len(row))
    step = max(1, CHUNK_BYTES // (16 * max(1, qv.shape[1])))
    for s in range(0, len(row), step):
        diff = qv[row[s:s + step]] - tv[col[s:s + step]]
        out[s:s + step] = np.sqrt(np.einsum("nd,nd->n", diff, diff))
    return out


def _screen(qv, tv, kk: int):
    """Pairs that may be among a query's ``kk`` nearest: all whose distance by a matrix product is
    within its rounding error of the query's kk-th."""
    mid = tv.mean(axis=0)
    q, t = qv - mid, tv - mid
    qq, tt = np.einsum("nd,nd->n", q, q), np.einsum("nd,nd->n", t, t)
    d = qq[:, None] + tt[None, :] - 2.0 * (q @ t.T)
    # Generous bound of the error of a sum of so many products, twice, and of taking off the middle.
    slack = 16.0 * (qv.shape[1] + 8) * np.finfo(float).eps * (qq + tt.max() + np.abs(mid).max() ** 2 * qv.shape[1])
    kth = np.partition(d, kk - 1, axis=1)[:, kk - 1]
    return np.nonzero(d <= (kth + slack)[:, None])


def _local_topk_fn(k: int, chunk: int):
    def local_topk(tp: pd.DataFrame, qp: pd.DataFrame) -> pd.DataFrame:
        cols = ["qid", "tid", "label", "dist"]
        if tp.empty or qp.empty:
            return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "tid": pd.Series([], dtype="int64"),
                                 "label": pd.Series([], dtype=tp["tlabel"].dtype if not tp.empty else "float64"),
                                 "dist": pd.Series([], dtype="float64")})[cols]
        tv = np.vstack(tp["tv"].to_numpy()).astype(np.float64)
        tid = tp["tid"].to_numpy()
        tl = tp["tlabel"].to_numpy()
        qv = np.vstack(qp["qv"].to_numpy()).astype(np.float64)
        qid = qp["qid"].to_numpy()
        kk = min(k, len(tid))
        # A NaN, infinity or a number whose square may not be one takes the way without the screen.
        plain = max(np.abs(x).max(initial=0.0) for x in (tv, qv)) < 1e100
        step = chunk if plain else max(1, min(chunk, CHUNK_BYTES // (16 * tv.size or 1)))
        out = []
        for s in range(0, len(qid), step):
            if plain:
                row, col = _screen(qv[s:s + step], tv, kk)
            else:
                row, col = (x.ravel() for x in np.indices((len(qid[s:s + step]), len(tid))))
            d = _exact(qv[s:s + step], tv, row, col)
            if not plain:  # a query with fewer than kk distances that are numbers has no neighbours
                known = np.bincount(row[~np.isnan(d)], minlength=len(qid[s:s + step])) >= kk
                ok = ~np.isnan(d) & known[row]
                row, col, d = row[ok], col[ok], d[ok]
            order = np.lexsort((tid[col], d, row))
            row, col, d = row[order], col[order], d[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, d = row[place < kk], col[place < kk], d[place < kk]
            out.append((qid[s + row], tid[col], tl[col], d))
        return pd.DataFrame(dict(zip(cols, (np.concatenate(x) for x in zip(*out)))))
    return local_topk


def _merge_topk(partial: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("dist", "tid")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _prepare(train, queries, train_key, query_key, vec, label):
    t = train.select(c(train_key).cast("long").alias("tid"),
                     F.col(vec).cast("array<double>").alias("tv"), c(label).alias("tlabel"))
    q = queries.select(c(query_key).cast("long").alias("qid"),
                       F.col(vec).cast("array<double>").alias("qv"))
    return t, q, train.schema[label].dataType.simpleString()


def neighbours(train: DataFrame, queries: DataFrame, k: int = 5, train_key: str = "id",
               query_key: str = "id", vec: str = "features", label: str = "label",
               block_rows: int = 16384, chunk: int = 64, method: str = "auto",
               pivot_threshold: int = 50_000) -> DataFrame:
    """(qid, tid, label, dist, rank) for the k nearest training rows of every query.

    ``method``: 'blocks' (every training block meets every query block),
    'pivots' (exact pruning, see :func:`neighbours_pivots`) or 'auto'
    (pivots when the training side has more than ``pivot_threshold`` rows).
    """
    if method == "auto":
        method = "pivots" if train.count() > pivot_threshold else "blocks"
    if method == "pivots":
        return neighbours_pivots(train, queries, k, train_key, query_key, vec, label,
                                 block_rows=block_rows, chunk=chunk)
    t, q, label_type = _prepare(train, queries, train_key, query_key, vec, label)
    t, n_tb = _block(t, "tid", block_rows, "tb", 7)
    q, n_qb = _block(q, "qid", block_rows, "qb", 11)
    t = t.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1))))
    q = q.withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(n_tb - 1))))
    schema = f"qid long, tid long, label {label_type}, dist double"
    partial = (t.groupBy("tb", "qb").cogroup(q.groupBy("tb", "qb"))
               .applyInPandas(_local_topk_fn(k, chunk), schema))
    return _merge_topk(partial, k)


def _dists_to(x: np.ndarray, piv: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(piv)))
    chunk = max(1, CHUNK_BYTES // (8 * max(1, piv.size)))
    for s in range(0, len(x), chunk):
        diff = x[s:s + chunk, None, :] - piv[None, :, :]
        out[s:s + chunk] = np.sqrt(np.einsum("qpd,qpd->qp", diff, diff))
    return out


def _blocks_of(sizes: dict, piv: np.ndarray, block_rows: int):
    """First block and number of blocks of each cell, and the number of blocks in all."""
    first, n_sub = np.zeros(len(piv), dtype=np.int64), np.zeros(len(piv), dtype=np.int64)
    blocks, filled = 0, 0
    # Cells by their pivot's distance from the first pivot: near ones tend to share blocks.
    for cell in np.argsort(_dists_to(piv, piv[:1])[:, 0], kind="stable"):
        n = sizes.get(int(cell), 0)
        if not n:
            continue
        if filled and filled + n > block_rows:
            blocks, filled = blocks + 1, 0
        first[cell], n_sub[cell] = blocks, max(1, math.ceil(n / block_rows))
        filled += n
        if filled >= block_rows:
            blocks, filled = blocks + int(n_sub[cell]), 0
    return first, n_sub, blocks + (filled > 0)


def neighbours_pivots(train: DataFrame, queries: DataFrame, k: int = 5, train_key: str = "id",
                      query_key: str = "id", vec: str = "features", label: str = "label",
                      n_pivots: int | None = None, block_rows: int = 16384, chunk: int = 64,
                      max_pivots: int = 4096) -> DataFrame:
    """Exact k nearest neighbours with pivot pruning (one round).

    * Pivots are the P training rows with the lowest hash of their id; every
      training row joins the cell of its nearest pivot and keeps that distance;
      a cell's radius is its largest member distance (one aggregation, P rows).
    * Pivots are training rows, so the k-th nearest pivot of a query bounds its
      k-th neighbour distance U. By the triangle inequality a cell can hold a
      neighbour only if d(q, pivot) - radius <= U; only those (query, cell)
      pairs are formed - the result is exact, the work shrinks with locality.
    * Cells make blocks of about ``block_rows`` training rows: a larger cell is split by the hash of
      the id, smaller ones near each other share a block. A query goes once to every block with a
      cell that can hold a neighbour, and queries are dealt into chunks of about as many rows, so
      every ``cogroup`` group stays bounded even when one cell holds a third of the data, and
      where nothing is pruned a vector is copied once per block, not once per cell.
    Only the pivot vectors (P x dim) and per-cell numbers (P rows) are collected.
    """
    t, q, label_type = _prepare(train, queries, train_key, query_key, vec, label)
    spark = t.sparkSession
    n_train = t.count()
    if n_train == 0:
        return spark.createDataFrame([], f"qid long, tid long, label {label_type}, dist double, rank int")
    p = n_pivots or int(min(max_pivots, max(k + 1, round(math.sqrt(n_train)))))
    p = min(p, n_train)
    piv_rows = (t.withColumn("__h", key_hash(F.col("tid"), 17)).orderBy("__h", "tid").limit(p)
                .select("tv").collect())
    piv = np.array([r["tv"] for r in piv_rows], dtype=np.float64)
    bpiv = spark.sparkContext.broadcast(piv)

    def assign(batches):
        pv = bpiv.value
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(cell=pd.Series([], dtype="int32"), dcell=pd.Series([], dtype="float64"))
                continue
            d = _dists_to(np.vstack(pdf["tv"].to_numpy()).astype(np.float64), pv)
            cell = d.argmin(axis=1)
            yield pdf.assign(cell=cell.astype("int32"), dcell=d[np.arange(len(d)), cell])

    tc = t.mapInPandas(assign, f"tid long, tv array<double>, tlabel {label_type}, cell int, dcell double")
    cells = tc.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dcell").alias("radius")).collect()
    radius = np.full(len(piv), -np.inf)
    for r in cells:
        radius[r["cell"]] = r["radius"]
    first, n_sub, n_blocks = _blocks_of({r["cell"]: r["n"] for r in cells}, piv, block_rows)
    n_chunks = max(1, math.ceil(q.count() / block_rows))
    broute = spark.sparkContext.broadcast((radius, first, n_sub, n_blocks))
    kk = min(k, len(piv))

    def route(batches):
        pv, (rad, begin, subs, blocks) = bpiv.value, broute.value
        live = np.isfinite(rad)
        step = max(1, CHUNK_BYTES // (8 * max(blocks * pv.shape[1], len(pv))))
        for whole in batches:
            for pdf in (whole.iloc[s:s + step] for s in range(0, max(1, len(whole)), step)):
                if pdf.empty:
                    yield pd.DataFrame({"qid": pd.Series([], dtype="int64"), "qv": pd.Series([], dtype=object),
                                        "block": pd.Series([], dtype="int32")})
                    continue
                d = _dists_to(np.vstack(pdf["qv"].to_numpy()).astype(np.float64), pv)
                u = np.partition(d, kk - 1, axis=1)[:, kk - 1]
                slack = 1e-9 * (np.abs(u) + 1.0)
                ok = (d - np.where(live, rad, np.inf)[None, :]) <= (u + slack)[:, None]
                to = np.zeros((len(pdf), blocks + 1), dtype=np.int32)
                at, cell = np.nonzero(ok & live)
                np.add.at(to, (at, begin[cell]), 1)
                np.add.at(to, (at, begin[cell] + subs[cell]), -1)
                qi, bi = np.nonzero(to.cumsum(axis=1)[:, :blocks])
                yield pd.DataFrame({"qid": pdf["qid"].to_numpy()[qi], "qv": pdf["qv"].to_numpy()[qi],
                                    "block": bi.astype("int32")})

    pairs = q.mapInPandas(route, "qid long, qv array<double>, block int")
    # One row per cell (P rows): a bounded table.
    plan = [(r["cell"], int(first[r["cell"]]), int(n_sub[r["cell"]])) for r in cells]
    cell_plan = F.broadcast(spark.createDataFrame(plan, "cell int, first int, n_sub int"))
    tk = (tc.join(cell_plan, "cell")
          .withColumn("block", (F.col("first") + key_hash(F.col("tid"), 7) % F.col("n_sub")).cast("int"))
          .withColumn("qchunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
          .select("block", "qchunk", "tid", "tv", "tlabel"))
    qk = pairs.withColumn("qchunk", (key_hash(F.col("qid"), 11) % n_chunks).cast("int"))
    schema = f"qid long, tid long, label {label_type}, dist double"
    partial = (tk.groupBy("block", "qchunk").cogroup(qk.groupBy("block", "qchunk"))
               .applyInPandas(_local_topk_fn(k, chunk), schema))
    return _merge_topk(partial, k)


def vote(nbrs: DataFrame, task: str = CLASSIFICATION) -> DataFrame:
    """(qid, prediction): majority label, smallest on ties; or mean label."""
    if task == REGRESSION:
        return nbrs.groupBy("qid").agg(F.avg(F.col("label").cast("double")).alias("prediction"))
    votes = nbrs.groupBy("qid", "label").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("qid").orderBy(F.col("votes").desc(), F.col("label").asc())
    return (votes.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
            .select("qid", F.col("label").alias("prediction")))


class KNNEstimator(Estimator):
    """``fit`` keeps the training frame; ``transform`` runs the exact search."""

    def __init__(self, task: str = CLASSIFICATION, k: int = 5, featuresCol: str = "features",
                 labelCol: str = "label", idCol: str = "id", block_rows: int = 16384):
        super().__init__()
        self.task, self.k, self.features_col, self.label_col = task, k, featuresCol, labelCol
        self.id_col, self.block_rows = idCol, block_rows

    def setFeaturesCol(self, v):
        self.features_col = v
        return self

    def setLabelCol(self, v):
        self.label_col = v
        return self

    def _fit(self, df: DataFrame):
        return KNNModel(self, df)


class KNNModel(StoredModel):
    """The training rows and the settings; stored as a frame of id, features and label."""

    def __init__(self, est: KNNEstimator, train: DataFrame):
        super().__init__()
        self.est, self.train = est, train

    def state(self):
        e = self.est
        values = {"task": e.task, "k": e.k, "featuresCol": e.features_col, "labelCol": e.label_col,
                  "idCol": e.id_col, "block_rows": e.block_rows}
        return values, {"train": self.train.select(c(e.id_col), c(e.features_col), c(e.label_col))}, {}

    @classmethod
    def from_state(cls, values, frames, models):
        return cls(KNNEstimator(**values), frames["train"])

    def _transform(self, df: DataFrame) -> DataFrame:
        e = self.est
        vec_of = (lambda d: d.withColumn("__vec", F.col(e.features_col) if
                  d.schema[e.features_col].dataType.simpleString().startswith("array")
                  else _vector_to_array(e.features_col)))
        tr, qs = vec_of(self.train), vec_of(df)
        nb = neighbours(tr, qs, e.k, e.id_col, e.id_col, "__vec", e.label_col, e.block_rows)
        pred = vote(nb, e.task)
        if e.task == CLASSIFICATION:
            pred = pred.withColumn("prediction", F.col("prediction").cast("double"))
        return df.join(pred, df[e.id_col] == pred["qid"], "left").drop("qid")


def _vector_to_array(col: str):
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col))
