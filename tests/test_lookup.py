"""Dictionary joins that shuffle only rows of rare values."""

from pyspark.sql import functions as F

from quarry.operators import features as FE
from quarry.operators import tfidf as TF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frequent_values_are_broadcast(spark, monkeypatch):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("v"), "id")).alias("value"))
    table = rows.groupBy("value").agg(F.count(F.lit(1)).alias("count")).where("value != 'v9'").withColumn("index", F.xxhash64("value"))
    want = sorted(rows.join(table, "value").select("id", "value", "index").collect())
    whole = FE.lookup(rows, table, ["value"], "count").select("id", "value", "index")
    assert sorted(whole.collect()) == want
    monkeypatch.setattr(FE, "BROADCAST_BYTES", 0)
    split = FE.lookup(rows, table, ["value"], "count", most=20)
    assert sorted(split.select("id", "value", "index").collect()) == want
    assert FE.frequent_rows(table, "count", 2999, 20).count() == 1


def test_sparse_one_hot_of_a_large_dictionary(spark, monkeypatch):
    df = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "a").alias("p"), (F.col("id") * 7).cast("string").alias("q"))
    fitted = FE.fit_one_hot(df, ["p", "q"])
    want = sorted(FE.one_hot_entries(df, ["id"], fitted).collect())
    monkeypatch.setattr(FE, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(FE, "FREQUENT_ROWS", 10)
    split = FE.one_hot_entries(df, ["id"], fitted)
    assert len(want) == 600 and sorted(split.collect()) == want
    assert "BroadcastHashJoin" in plan_of(split)


def test_tfidf_shuffles_texts_not_terms(spark, monkeypatch):
    texts = [(i, f"common words and word{i} word{i % 7} common") for i in range(50)] + [(3, "again common"), (None, "lost")]
    docs = spark.createDataFrame(texts, "id int, text string")
    v = TF.fit(docs, "id", "text")
    rows = TF.weights(docs, "id", "text", v)
    plan = plan_of(rows)
    assert "hashpartitioning(key" in plan and "hashpartitioning(term" not in plan and "hashpartitioning(key#" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    want = sorted(rows.select("key", "term", "term_id", "tf", F.round("weight", 9)).collect())
    assert {r["tf"] for r in want if r["key"] == 3 and r["term"] == "common"} == {3}
    monkeypatch.setattr(FE, "BROADCAST_BYTES", 0)
    again = TF.weights(docs, "id", "text", v)
    assert sorted(again.select("key", "term", "term_id", "tf", F.round("weight", 9)).collect()) == want
