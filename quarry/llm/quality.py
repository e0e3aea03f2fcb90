"""Quality classifier: regularised quadratic discriminant on document statistics (operator 2).

Each text becomes a short vector of transformed statistics. Per class, the labelled training
rows give a mean and a covariance (sums and products added up by Spark); the covariance is
shrunk towards the pooled one and towards a multiple of the identity, and factored once
(Cholesky). A text's score is the posterior from the two Mahalanobis log densities.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fold, labelled_sample, worker_state

STATISTICS = ["word_length", "upper", "symbols", "digits", "stops", "variety", "repeats", "line_length"]
_SENTENCE = b".,;:?-'\"()"  # marks that prose has too
_CHUNK = 1 << 20            # bytes of a long text counted at a time


def _chunks(data: bytes):
    """Whole-word pieces of at most about a megabyte."""
    at = 0
    while len(data) - at > _CHUNK:
        cut = max(data.rfind(b" ", at, at + _CHUNK), data.rfind(b"\n", at, at + _CHUNK))
        cut = cut if cut > at else at + _CHUNK
        yield data[at:cut]
        at = cut
    yield data[at:]


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text (null counts as empty).

    Shares become log odds, smoothed so that empty texts have a value; counts become logs."""
    import operator

    import numpy as np

    data = (text or "").encode("utf-8", "replace")
    hist = np.zeros(256, dtype=np.int64)
    words, letters_in_words, same, last = 0, 0, 0, None
    kinds: set[bytes] = set()
    for piece in _chunks(data):
        hist += np.bincount(np.frombuffer(piece, dtype=np.uint8), minlength=256)
        some = piece.split()
        if some:
            words += len(some)
            letters_in_words += sum(map(len, some))
            same += sum(map(operator.eq, some, some[1:])) + (some[0] == last)
            last = some[-1]
            kinds.update(some)
    upper, lower, digits = int(hist[65:91].sum()), int(hist[97:123].sum()), int(hist[48:58].sum())
    prose = int(hist[list(_SENTENCE)].sum())
    blank = int(hist[[9, 10, 11, 12, 13, 32]].sum())
    symbols = int(hist[:128].sum()) - upper - lower - digits - prose - blank
    lines = int(hist[10]) + 1

    def odds(part: float, of: float, typical: float, soft: float = 40) -> float:
        # Smoothed towards a typical share, so that a short text is not an odd one.
        x = (part + soft * typical) / (of + soft)
        return math.log(x / (1 - x))

    return [math.log((letters_in_words + 100) / (words + 20)), odds(upper, upper + lower, 0.04),
            odds(symbols, len(data), 0.002), odds(digits, len(data), 0.002), odds(int(hist[46]), words, 0.1),
            math.log((len(kinds) + 20) / (words + 20)), odds(same, max(words - 1, 0), 0.005),
            math.log((len(data) + 600) / (lines + 5))]


@dataclass
class Discriminant:
    """Fitted means, inverse Cholesky factors, log determinants and log prior odds."""

    means: list
    factors: list  # inverses of the lower Cholesky factors
    logdets: list
    log_odds: float
    constant: float | None = None  # the score of every text where a class has too few rows

    def scores(self, x):
        import numpy as np

        x = np.asarray(x, dtype=float).reshape(-1, len(STATISTICS))
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            z = (x - mean) @ factor.T
            density.append(-0.5 * ((z * z).sum(axis=1) + logdet))
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "quality",
        folds: int = 5, held_out: int = 0, max_labelled: int = 50_000,
        pooling: float = 0.1, ridge: float = 0.05) -> Discriminant:
    """Fit on labelled rows whose crc32(id) mod ``folds`` is not ``held_out``.

    At most ``max_labelled`` of them (those with the smallest id hashes) are read. ``pooling``
    is the share of the pooled covariance in each class covariance, at least; a class with few
    rows gets more. ``ridge`` is the share of the scaled identity. Without any usable label
    every score is 0.5; with one class, its share."""
    import numpy as np

    d = len(STATISTICS)
    sample = labelled_sample(labels, id_col, label_col, folds, held_out, max_labelled)
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(sample), "_id").select("_text", "_y"))

    def sums(batches):
        import pyarrow as pa

        total = {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array([1.0, *statistics(text)])
                total[y] = total.get(y, 0) + np.outer(x, x)
        for y, m in total.items():
            yield pa.RecordBatch.from_pydict({"y": [y] * m.size, "i": list(range(m.size)), "v": m.ravel().tolist()},
                                             schema=pa.schema([("y", pa.int32()), ("i", pa.int32()), ("v", pa.float64())]))

    # (d + 1)^2 sums per class reach the driver, whatever the input.
    moments = {y: np.zeros((d + 1) ** 2) for y in (0, 1)}
    for r in rows.mapInArrow(sums, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        moments[r["y"]][r["i"]] = r["v"]
    moments = [moments[y].reshape(d + 1, d + 1) for y in (0, 1)]
    n = [m[0, 0] for m in moments]
    if min(n) < 2:
        return Discriminant([], [], [], 0.0, constant=n[1] / sum(n) if sum(n) else 0.5)
    means = [m[0, 1:] / m[0, 0] for m in moments]
    scatter = [m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0] for m in moments]
    pooled = sum(scatter) / sum(n)
    factors, logdets = [], []
    for s, count in zip(scatter, n, strict=True):
        share = max(pooling, (d + 1) / (count + d + 1))
        cov = (1 - share) * s / count + share * pooled
        # The identity is scaled per statistic by the pooled variances.
        cov = (1 - ridge) * cov + ridge * np.diag(np.maximum(np.diag(pooled), 1e-6))
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        logdets.append(2.0 * float(np.log(np.diag(lower)).sum()))
    return Discriminant(means, factors, logdets, math.log(n[1] / n[0]))


def score(model: Discriminant, text):
    """Score column of a text column: 0 to 1, higher for texts of class 1."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        worker_state("quality", "nothing", None, lambda: None)  # other operators' caches go
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.scores([statistics(t) for t in texts]))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "quality",
             folds: int = 5, held_out: int = 0, threshold: float = 0.3, **fit_options) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts have a score like any other; rows with a null or repeated id stay, one
    result row each; labels are read by id alone (null labels and ids left out, an id labelled
    both ways takes no part); other columns, whatever their names, are not read; empty tables
    give an empty result."""
    model = fit(docs, labels, id_col, text_col, label_col, folds, held_out, **fit_options)
    scored = docs.select(F.col(id_col), (fold(F.col(id_col), folds) == held_out).alias("held_out"),
                         score(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
