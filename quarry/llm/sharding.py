"""Rendezvous sharding of stable record keys (operator 6), native DataFrame functions.

Each (key, shard) pair has a hash u in (0, 1); the record goes to the shard with the
smallest ``-ln(u) / weight``. A shard's score depends on the key and that shard alone, so
a new shard only takes the records it wins and moves no other; weights set the shares.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import write_stage

_HEX = 13  # hex digits of the hash in use: 52 bits, exact in a double


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard (0-based) of ``key`` among ``len(weights)`` weighted shards.

    A null key counts as the empty text. Equal scores go to the smaller shard."""
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights):
        raise ValueError("weights must be positive and finite, one per shard")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(s: int) -> Column:
        digits = F.conv(F.substring(F.md5(F.concat(text, F.lit(f"#{s}")).cast("binary")), 1, _HEX), 16, 10)
        u = (digits.cast("double") + F.lit(0.5)) / F.lit(float(16 ** _HEX))
        return F.struct((-F.log(u) / F.lit(float(weights[s]))).alias("score"), F.lit(s).alias("shard"))

    if len(weights) == 1:
        return F.lit(0)
    return F.array_min(F.array(*[score(s) for s in range(len(weights))]))["shard"]


def shard_records(docs: DataFrame, key_col: str, text_col: str, weights: list[float],
                  grown_weight: float | None = 1.0, parts: int | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1); ``slot`` numbers each shard's
    rows from 0 without gaps in the order of the key; ``grown_shard`` is the shard once one
    more shard of weight ``grown_weight`` joins. Null keys share one shard; repeated rows go
    to the same shard and get different slots; an empty table gives an empty result; other
    columns, whatever their names, are not read.

    Slots need no task to hold a shard: rows are range-partitioned by (shard, key, row
    number of the scan), sorted and written; a row's slot is its place in its range plus the
    shard's rows in earlier ranges. The last sort column splits repeated rows too.
    """
    spark = docs.sparkSession
    key, text = F.col(key_col), F.col(text_col)
    bytes_ = F.coalesce(text, F.lit("")).cast("binary")
    grown = shard_of(key, [*weights, grown_weight]) if grown_weight is not None else F.lit(None).cast("int")
    rows = docs.select(key.alias("_key"), (F.octet_length(bytes_).cast("bigint") + F.lit(1)).alias("_size"),
                       F.crc32(bytes_).alias("_crc"), shard_of(key, weights).cast("int").alias("_shard"),
                       grown.cast("int").alias("_grown"), F.monotonically_increasing_id().alias("_row"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["_shard", "_key", "_size", "_crc", "_row"]
    placed = write_stage(
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()).drop("_row"), "shards")
    # The id's upper bits are the range, its lower 33 bits the place in it.
    placed = (placed.withColumn("_range", F.shiftright("_place", 33))
              .withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))))
    # One row per (range, shard) that occurs: fewer than ranges + shards, whatever the input,
    # so this table is broadcast.
    heads = placed.groupBy("_range", "_shard").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.expr("coalesce(sum(_n) over (partition by _shard order by _range "
                    "rows between unbounded preceding and 1 preceding), 0)")
    heads = heads.select("_range", "_shard", "_first", before.alias("_before"))
    return placed.join(F.broadcast(heads), ["_range", "_shard"]).select(
        F.col("_key").alias(key_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("key").alias("law"), F.col("_shard").alias("shard"),
        (F.col("_place") - F.col("_first") + F.col("_before")).alias("slot"),
        F.col("_grown").alias("grown_shard"))
