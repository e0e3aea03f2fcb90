import os
import time

import pytest
from pyspark.sql import functions as F
from quarry.llm import _common
from quarry.llm._common import shuffles_freed, write_stage

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f"{d}/{n}" for root in top for d, _, names in os.walk(root) for n in names if n.startswith("shuffle_")}


def test_a_stage_leaves_no_shuffle_files(spark):
    """Kept until the driver collects its garbage, those of many stages filled the disk."""
    rows = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s"))
    before = shuffle_files(spark)
    out = write_stage(rows.join(rows.withColumnRenamed("s", "t"), "k"), "stage")
    until = time.time() + 10  # executors delete them on their own
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert {r["k"]: (r["s"], r["t"]) for r in out.collect()} == {k: (s, s) for k in range(10) for s in [sum(range(k, 1000, 10))]}


def test_the_setting_comes_back(spark):
    for was in (None, "false", "true"):
        if was is None:
            spark.conf.unset(KEY)
        else:
            spark.conf.set(KEY, was)
        with pytest.raises(ZeroDivisionError), shuffles_freed(spark):
            assert spark.conf.get(KEY) == "true"
            raise ZeroDivisionError
        assert spark.conf.get(KEY, None) == was
    spark.conf.unset(KEY)
    assert _common.write_stage(spark.range(0), "empty").count() == 0


def test_a_worker_that_goes_on_gives_memory_back(monkeypatch):
    """Caches of the operator before and the unused memory of Arrow's pool go once, as the operator changes."""
    import sys

    import pyarrow as pa

    class Pool:
        released = 0

        def release_unused(self):
            Pool.released += 1

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    monkeypatch.delitem(sys.modules, "_quarry_llm_worker", raising=False)
    first = _common.worker_state("one", "words", None, dict)
    assert _common.worker_state("one", "words", None, dict) is first
    begun = Pool.released
    assert _common.worker_state("two", "words", None, dict) is not first
    assert Pool.released == begun + 1
    assert _common.worker_state("two", "more", None, dict) == {} and Pool.released == begun + 1
    sys.modules.pop("_quarry_llm_worker")
