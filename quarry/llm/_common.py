"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries that run inside give their shuffle files back when they end.

    Otherwise the files of every query stay on the executors' disks until the driver happens to
    collect its garbage, and those of many small queries add up."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def write_stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage with files every executor sees, so a lost executor costs a
    re-read and not a recomputation; the read-back frame has true sizes for the
    optimizer's join choices. The shuffle files of the write go when it ends: nothing reads them
    again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def worker_state(operator: str, name: str, key, build):
    """A value kept by one Python worker process across its tasks (caches, tokenizers).

    Functions of this package travel by value, so their module globals are new in each task;
    this holder lives in ``sys.modules`` of the worker. It keeps the values of one operator at a
    time, and of each ``name`` the one for the latest ``key``: a worker that goes on to another
    stage gives the last one's caches back, and what Arrow keeps of its batches."""
    import pyarrow as pa

    holder = sys.modules.setdefault("_quarry_llm_worker", types.ModuleType("_quarry_llm_worker"))
    states = holder.__dict__.setdefault("states", {})
    if holder.__dict__.get("operator") != operator:
        states.clear()
        pa.default_memory_pool().release_unused()
        holder.operator = operator
    if name not in states or states[name][0] != key:
        states.pop(name, None)
        states[name] = (key, build())
    return states[name][1]


def sliced(batches, rows: int):
    """Arrow batches in slices of at most ``rows`` rows: what a task makes of them at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id: of the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y): one label per id. Null ids and null labels are left out, repeated rows
    count once, and an id labelled both ways takes no part."""
    y = F.col(label_col).cast("int")
    return (labels.where(F.col(id_col).isNotNull() & y.isin(0, 1))
            .groupBy(F.col(id_col).alias("_id"))
            .agg(F.min(y).alias("_lo"), F.max(y).alias("_y"))
            .where("_lo = _y").select("_id", "_y"))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, folds: int, held_out: int,
                    max_rows: int) -> DataFrame:
    """(_id, _y): labels of the training folds, at most ``max_rows`` of them.

    The rows with the smallest id hashes are taken, so the choice does not depend on the
    order or the partitions; the row bound makes the result fit for a broadcast."""
    train = one_label(labels, id_col, label_col).where(fold(F.col("_id"), folds) != held_out)
    return train.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
