"""Stand-in prediction inputs built from the test tables.

These only produce rows in the shape the evaluation and ensemble operators
take - (key, label, prediction[, score]) - from fixed CASE rules, so their SQL
oracles exist. They do none of the operators' work.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.scan import read_table


def order_status_predictions(spark, sf):
    """(o_orderkey, label, prediction) for o_orderstatus from a date/price rule."""
    o = read_table(spark, sf, "orders")
    pred = (F.when(F.col("o_orderdate") < F.lit("1997-01-01").cast(o.schema["o_orderdate"].dataType), "F")
            .when(F.col("o_totalprice") > 200000, "P").otherwise("O"))
    return o.select("o_orderkey", F.col("o_orderstatus").alias("label"), pred.alias("prediction"))


ORDER_STATUS_SQL = """(SELECT o_orderkey, o_orderstatus AS label,
  CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'F' WHEN o_totalprice > 200000 THEN 'P'
       ELSE 'O' END AS prediction FROM orders)"""


def quality_scores(spark, sf):
    """(doc_id, label, score, prediction) for labels.quality from document length."""
    d = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    l = read_table(spark, sf, "labels").select("doc_id", "quality")
    n = F.col("n_chars").cast("double")
    score = n / (n + F.lit(2000.0))
    return (l.join(d, "doc_id")
            .select("doc_id", F.col("quality").alias("label"), score.alias("score"),
                    F.when(score >= 0.5, 1).otherwise(0).alias("prediction")))


QUALITY_SQL = """(SELECT doc_id, quality AS label,
  CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + CAST(2000.0 AS DOUBLE)) AS score,
  CASE WHEN CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + CAST(2000.0 AS DOUBLE)) >= 0.5
       THEN 1 ELSE 0 END AS prediction
  FROM labels JOIN documents USING (doc_id))"""


def price_predictions(spark, sf):
    """(o_orderkey, label, p_priority, p_bucket, p_customer): three price rules."""
    o = read_table(spark, sf, "orders")
    prio = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(
        "o_orderkey", F.col("o_totalprice").alias("label"),
        (F.lit(100000.0) + F.lit(20000.0) * prio).alias("p_priority"),
        (F.floor(F.col("o_totalprice") / 10000.0) * 10000.0 + 5000.0).cast("double").alias("p_bucket"),
        (F.lit(50000.0) + F.lit(100.0) * (F.col("o_custkey") % 1000)).cast("double").alias("p_customer"))


PRICE_SQL = """(SELECT o_orderkey, o_totalprice AS label,
  CAST(100000.0 AS DOUBLE) + CAST(20000.0 AS DOUBLE) * CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p_priority,
  CAST(floor(o_totalprice / CAST(10000.0 AS DOUBLE)) * CAST(10000.0 AS DOUBLE) + CAST(5000.0 AS DOUBLE) AS DOUBLE) AS p_bucket,
  CAST(CAST(50000.0 AS DOUBLE) + CAST(100.0 AS DOUBLE) * (o_custkey % 1000) AS DOUBLE) AS p_customer
  FROM orders)"""
