"""Contract queries for splits and sampling (H1-H5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import key_hash_sql
from ..operators import splits as SP
from ..sources.scan import read_table
from .registry import register

H_ORDERS = key_hash_sql("o_orderkey")
H_LABELS = key_hash_sql("doc_id")


@register("split_holdout", f"""
SELECT o_orderkey, CASE WHEN {H_ORDERS} % 1000 < 200 THEN 'valid' ELSE 'train' END AS split
FROM orders""")
def split_holdout(spark, sf):
    return SP.holdout(read_table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "split")


@register("split_kfold", f"SELECT o_orderkey, CAST({H_ORDERS} % 5 AS INTEGER) AS fold FROM orders")
def split_kfold(spark, sf):
    return SP.kfold(read_table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "fold")


@register("split_stratified", f"""
SELECT doc_id, quality,
       CAST((row_number() OVER (PARTITION BY quality ORDER BY {H_LABELS}, doc_id) - 1) % 5 AS INTEGER)
         AS fold
FROM labels""")
def split_stratified(spark, sf):
    labels = read_table(spark, sf, "labels")
    return SP.stratified_kfold(labels, "doc_id", "quality").select("doc_id", "quality", "fold")


@register("split_timeseries", """
WITH ix AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx
            FROM orders),
n AS (SELECT count(*) AS n, count(*) // 6 AS size FROM orders)
SELECT o_orderkey, idx,
       CAST(CASE WHEN idx >= n - 5 * size THEN (idx - (n - 5 * size)) // size ELSE -1 END AS INTEGER)
         AS test_fold,
       CAST(CASE WHEN 6 - (n - idx + size - 1) // size <= 4
            THEN greatest(6 - (n - idx + size - 1) // size, 0) ELSE -1 END AS INTEGER) AS train_from_fold
FROM ix, n""")
def split_timeseries(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    out = SP.time_series_folds(o, ["o_orderdate", "o_orderkey"], 5)
    # -1 marks "no such fold" in the report (the operator returns NULL).
    return out.select("o_orderkey", "idx", F.coalesce("test_fold", F.lit(-1)).alias("test_fold"),
                      F.coalesce("train_from_fold", F.lit(-1)).alias("train_from_fold"))


@register("sample_5000", f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY {H_ORDERS}, o_orderkey LIMIT 5000""")
def sample_5000(spark, sf):
    o = read_table(spark, sf, "orders")
    return SP.sample_rows(o, "o_orderkey", 5000).select("o_orderkey", "o_totalprice")
