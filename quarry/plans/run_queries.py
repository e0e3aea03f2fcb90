"""Contract queries over a run-metrics table derived from ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import key_hash_sql
from ..operators import runs as RU
from ..operators import splits as SP
from ..sources.scan import read_table
from .common import rnd, round_doubles
from .registry import register


def runs_table(spark, sf):
    """Fixture: three order-status rules evaluated on five hash folds = 15 runs.

    run_id = model-vN, version = vN (fold N-1); metrics accuracy and
    error_rate; status 'completed' when accuracy >= 0.33 else 'failed'.
    """
    o = SP.kfold(read_table(spark, sf, "orders"), "o_orderkey", 5)
    rules = {
        "date_rule": F.when(F.col("o_orderdate") < F.lit("1997-01-01").cast(o.schema["o_orderdate"].dataType), "F")
                      .when(F.col("o_totalprice") > 200000, "P").otherwise("O"),
        "price_rule": F.when(F.col("o_totalprice") < 100000, "F")
                       .when(F.col("o_totalprice") < 200000, "O").otherwise("P"),
        "priority_rule": F.when(F.substring("o_orderpriority", 1, 1) == "1", "F")
                          .when(F.substring("o_orderpriority", 1, 1) == "2", "O").otherwise("P"),
    }
    parts = [o.select(F.lit(m).alias("model"), "fold", (r == F.col("o_orderstatus")).alias("hit"))
             for m, r in rules.items()]
    preds = parts[0].unionByName(parts[1]).unionByName(parts[2])
    acc = preds.groupBy("model", "fold").agg(F.avg(F.col("hit").cast("double")).alias("accuracy"))
    version = F.concat(F.lit("v"), (F.col("fold") + 1).cast("string"))
    runs = acc.select(F.concat_ws("-", "model", version).alias("run_id"), version.alias("version"),
                      "model", F.when(F.col("accuracy") >= 0.33, "completed").otherwise("failed").alias("status"),
                      F.explode(F.array(
                          F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")),
                          F.struct(F.lit("error_rate").alias("metric"), (1 - F.col("accuracy")).alias("value"))
                      )).alias("m"))
    return runs.select("run_id", "version", "model", "status", "m.metric", "m.value")


RUNS_SQL = f"""(WITH o AS (SELECT *, CAST({key_hash_sql('o_orderkey')} % 5 AS INTEGER) AS fold FROM orders),
p AS (SELECT 'date_rule' AS model, fold, o_orderstatus = CASE WHEN o_orderdate < TIMESTAMP '1997-01-01'
        THEN 'F' WHEN o_totalprice > 200000 THEN 'P' ELSE 'O' END AS hit FROM o
      UNION ALL SELECT 'price_rule', fold, o_orderstatus = CASE WHEN o_totalprice < 100000 THEN 'F'
        WHEN o_totalprice < 200000 THEN 'O' ELSE 'P' END FROM o
      UNION ALL SELECT 'priority_rule', fold, o_orderstatus = CASE WHEN substr(o_orderpriority, 1, 1) = '1'
        THEN 'F' WHEN substr(o_orderpriority, 1, 1) = '2' THEN 'O' ELSE 'P' END FROM o),
a AS (SELECT model, fold, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS accuracy FROM p GROUP BY ALL)
SELECT model || '-v' || (fold + 1) AS run_id, 'v' || (fold + 1) AS version, model,
       CASE WHEN accuracy >= 0.33 THEN 'completed' ELSE 'failed' END AS status,
       'accuracy' AS metric, accuracy AS value FROM a
UNION ALL
SELECT model || '-v' || (fold + 1), 'v' || (fold + 1), model,
       CASE WHEN accuracy >= 0.33 THEN 'completed' ELSE 'failed' END, 'error_rate', 1 - accuracy FROM a)"""


@register("runs_best", f"""
SELECT version, run_id, model, {rnd('value')} AS accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY version ORDER BY value DESC, run_id) AS r
  FROM {RUNS_SQL} WHERE metric = 'accuracy' AND status = 'completed' AND value IS NOT NULL)
WHERE r = 1""")
def runs_best(spark, sf):
    return round_doubles(RU.best_runs(runs_table(spark, sf), "accuracy"))


@register("runs_compare", f"""
SELECT run_id, version, model, status,
       {rnd("first(value) FILTER (WHERE metric = 'accuracy')")} AS accuracy,
       {rnd("first(value) FILTER (WHERE metric = 'error_rate')")} AS error_rate
FROM {RUNS_SQL} GROUP BY run_id, version, model, status""")
def runs_compare(spark, sf):
    return round_doubles(RU.compare_runs(runs_table(spark, sf), ["accuracy", "error_rate"]))


@register("runs_summary", f"""
WITH r AS (SELECT DISTINCT run_id, version, model, status FROM {RUNS_SQL})
SELECT count(*) AS total_runs, count(*) FILTER (WHERE status = 'completed') AS completed,
       count(*) FILTER (WHERE status = 'failed') AS failed,
       count(*) FILTER (WHERE status NOT IN ('completed', 'failed')) AS running,
       count(DISTINCT version) AS unique_versions, count(DISTINCT model) AS unique_models,
       string_agg(DISTINCT version, ',' ORDER BY version) AS versions,
       string_agg(DISTINCT model, ',' ORDER BY model) AS models
FROM r""")
def runs_summary(spark, sf):
    return RU.runs_summary(runs_table(spark, sf))
