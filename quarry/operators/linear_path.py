"""Lasso and elastic-net regularisation paths from one Gram matrix.

The loss (1 / 2n) |y - a - Xb|^2 + alpha (l1 |b|_1 + (1 - l1) / 2 |b|^2) depends on the data only
through the covariances of the features and the label, (k + 1)^2 numbers for k features. Tasks add
them up over Arrow batches; after that every alpha of the path is solved by coordinate descent on
the k x k matrix without another scan, each from the solution of the alpha before.

Rows with a NULL, NaN or infinite value in a feature or the label take no part. A constant feature
keeps the coefficient 0. No rows: all coefficients and intercepts are NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c


@dataclass
class Gram:
    """Number of rows, means and covariances (divided by n) of the features and, last, the label."""
    features: list
    n: int
    mean: np.ndarray
    cov: np.ndarray


def gram(df: DataFrame, features, label: str) -> Gram:
    """One cheap aggregation for the means, which are taken off before products are summed, and one
    pass that adds up the products; a task hands on one row per entry of the upper triangle."""
    features = list(features)
    numbers = df.select(*[c(x).cast("double").alias(f"v{i}") for i, x in enumerate([*features, label])])
    whole = None
    for x in numbers.columns:
        ok = F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
        whole = ok if whole is None else whole & ok
    numbers = numbers.where(whole)
    first = numbers.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in numbers.columns]).first()
    k = len(numbers.columns)
    if not first["n"]:
        return Gram(features, 0, np.full(k, np.nan), np.full((k, k), np.nan))
    mean = np.array([first[x] for x in numbers.columns])

    def products(batches):
        import pyarrow as pa

        total = np.zeros((k, k))
        for batch in batches:
            x = np.column_stack([col.to_numpy(zero_copy_only=False) for col in batch.columns]) - mean
            total += x.T @ x
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    rows = numbers.mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    cov = np.zeros((k, k))
    for r in rows:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["s"] / first["n"]
    return Gram(features, first["n"], mean, cov)


def descend(cov: np.ndarray, cxy: np.ndarray, alpha: float, l1: float, start: np.ndarray, tol: float = 1e-12,
            rounds: int = 100_000) -> np.ndarray:
    """Coordinate descent: each coefficient in turn takes its best value, until a round changes none
    by more than ``tol`` of the largest."""
    b = start.copy()
    shrink, grow = alpha * l1, np.diag(cov) + alpha * (1 - l1)
    left = cxy - cov @ b
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(np.diag(cov) > 0):
            pull = left[j] + cov[j, j] * b[j]
            new = np.sign(pull) * max(abs(pull) - shrink, 0.0) / grow[j]
            if new != b[j]:
                left -= cov[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]) * np.sqrt(cov[j, j]))
                b[j] = new
        if moved <= tol * max(1e-300, float(np.max(np.abs(b) * np.sqrt(np.diag(cov))))):
            break
    return b


def alphas_for(g: Gram, l1: float = 1.0, n: int = 100, ratio: float = 1e-3) -> list[float]:
    """A geometric grid from the least alpha that leaves no feature down to ``ratio`` of it."""
    top = float(np.max(np.abs(g.cov[:-1, -1]))) / max(l1, 1e-3) if g.n else 0.0
    return [float(x) for x in np.geomspace(top, top * ratio, n)] if top > 0 else [0.0]


def path(g: Gram, alphas=None, l1: float = 1.0) -> list[tuple[float, np.ndarray, float]]:
    """(alpha, coefficients, intercept) for each alpha, in the given order."""
    alphas = alphas_for(g, l1) if alphas is None else list(alphas)
    k = len(g.features)
    if not g.n:
        return [(a, np.full(k, np.nan), float("nan")) for a in alphas]
    cov, cxy, solved, b = g.cov[:-1, :-1], g.cov[:-1, -1], {}, np.zeros(k)
    for a in sorted(set(alphas), reverse=True):  # the strongest first: the next starts near its solution
        b = descend(cov, cxy, a, l1, b)
        solved[a] = b
    return [(a, solved[a], float(g.mean[-1] - g.mean[:-1] @ solved[a])) for a in alphas]


def path_frame(spark, g: Gram, alphas=None, l1: float = 1.0) -> DataFrame:
    """(alpha, feature, coefficient, intercept, n_nonzero): a row per alpha and feature."""
    rows = []
    for a, b, intercept in path(g, alphas, l1):
        bad = not np.isfinite(intercept)
        rows += [(float(a), x, None if bad else float(v), None if bad else intercept, None if bad else int(np.count_nonzero(b)))
                 for x, v in zip(g.features, b)]
    return spark.createDataFrame(rows, "alpha double, feature string, coefficient double, intercept double, n_nonzero int")
