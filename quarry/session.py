"""Session helpers: one place for the settings every job here relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators assume. Timestamps are compared with DuckDB, so the
# session time zone is pinned to UTC; AQE re-plans joins and coalesces
# shuffle partitions at run time; the UI stays off (no server is opened).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM interprets methods above this size; Spark then makes several smaller ones instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.scheduler.mode": "FAIR",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings in ``BASE_CONF``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is. Only when it is unset on a ``local`` master (tests) a scratch folder is
    created; any other master without the setting raises, since the driver's disk is
    not the executors'.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


ROWS_PER_FILE = 1_000_000  # of stored rows, so that a few writers leave files for many readers


@contextmanager
def stored_rows(df: DataFrame, name: str, by: str, writers: int = 0):
    """``df`` as Parquet under the shared checkpoint folder, read back, for as long as the block runs.

    The column ``by`` partitions the files, so a filter on it reads its own rows only. A task that
    meets at most ``writers`` values of it writes them side by side instead of sorting its rows."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    try:
        if writers:
            spark.conf.set(key, str(writers))
        try:
            df.write.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(by).parquet(path)
        finally:
            if writers:
                spark.conf.unset(key) if before is None else spark.conf.set(key, before)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cluster_conf(total_cores: int, input_bytes: int | None = None) -> dict:
    """Settings for a large cluster, sized from the core count (and input size).

    * shuffle partitions: 3 x cores as the starting point; AQE coalesces small
      ones and splits skewed ones, so the initial number only has to be large
      enough that no partition spills badly;
    * scan splits of 256 MB: 100 TB reads as ~400k tasks, a few waves over 1000
      executors, each task well inside executor memory;
    * Arrow batches of 10k rows bound the memory of the pandas functions
      (kNN groups, isolation-forest scoring).
    """
    parts = max(200, 3 * total_cores)
    if input_bytes:
        parts = max(parts, input_bytes // (512 << 20))  # about 512 MB of input per shuffle partition
    return {
        **BASE_CONF,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }
