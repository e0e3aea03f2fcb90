"""Deterministic splits and sampling.

Assignments hash ``seed:key`` with md5, so they do not depend on partitioning
and survive recomputation after executor loss; DuckDB computes the same hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c
from ..functions.hashing import key_hash
from .ordering import IDX, row_index


def with_hash(df: DataFrame, key: str, seed: int = 42, out: str = "__h") -> DataFrame:
    return df.withColumn(out, key_hash(c(key), seed))


def holdout(df: DataFrame, key: str, valid_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """split = 'valid' for hash buckets below ``valid_fraction`` (of 1000), else 'train' (H2)."""
    cut = int(round(valid_fraction * 1000))
    h = key_hash(c(key), seed)
    return df.withColumn("split", F.when(h % 1000 < cut, "valid").otherwise("train"))


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold = hash mod k (H3)."""
    return df.withColumn("fold", (key_hash(c(key), seed) % k).cast("int"))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Within each class, rows ordered by hash get folds 0, 1, .., k-1 in turn (H4).

    The per-class position comes from the range-partitioned row index, so a
    class with a third of the rows is still spread over many tasks.
    """
    h = with_hash(df, key, seed)
    ix = row_index(h, ["__h", key], partition_cols=[label])
    return ix.withColumn("fold", (F.col(IDX) % k).cast("int")).drop("__h", IDX)


def time_series_folds(df: DataFrame, order_cols, k: int = 5) -> DataFrame:
    """Expanding-window folds (H5, W7): test size = n div (k + 1); fold i tests rows
    [n - (k - i) * size, n - (k - i - 1) * size) and trains on all earlier rows.

    Adds idx, test_fold (NULL when never tested) and train_from_fold (first
    fold whose training part holds the row; NULL when none)."""
    ix = row_index(df, order_cols)
    n = ix.count()
    size = n // (k + 1)
    idx = F.col(IDX)
    if size == 0:
        return ix.select(*df.columns, idx.alias("idx"), F.lit(None).cast("int").alias("test_fold"),
                         F.lit(None).cast("int").alias("train_from_fold"))
    start = n - k * size
    test_fold = F.when(idx >= start, ((idx - start) / size).cast("int"))
    first = F.lit(k + 1) - ((F.lit(n) - idx + F.lit(size - 1)) / size).cast("bigint")
    train_from = F.when(first <= k - 1, F.greatest(first, F.lit(0))).cast("int")
    return ix.select(*df.columns, idx.alias("idx"), test_fold.alias("test_fold"),
                     train_from.alias("train_from_fold"))


def sample_rows(df: DataFrame, key: str, n: int = 5000, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all when fewer): the lowest hashes of ``seed:key`` (H1).

    A top-n: each task keeps its n lowest hashes before the merge, so at most
    n x tasks rows move.
    """
    h = with_hash(df, key, seed)
    return h.orderBy(F.col("__h"), c(key)).limit(n).drop("__h")
