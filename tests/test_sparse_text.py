"""Exact tf-idf vocabulary and sparse one-hot entries."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import features as FE
from quarry.operators import tfidf as TF

TEXTS = ["The cat, the CAT!", "a dog", None, "", "cat dog élan élan", "...", "zebra"]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def brute(min_df=1):
    tokens = {i: Counter(re.sub(r"[^\w\s]", "", t.lower()).split()) for i, t in enumerate(TEXTS) if t is not None}
    df = Counter(w for c in tokens.values() for w in c)
    vocab = sorted(w for w in df if df[w] >= min_df)
    n = len(tokens)
    out = {}
    for i, c in tokens.items():
        raw = {w: c[w] * (math.log((1 + n) / (1 + df[w])) + 1) for w in c if df[w] >= min_df}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out |= {(i, w, vocab.index(w), c[w]): v / norm for w, v in raw.items()}
    return out, len(vocab)


@pytest.mark.parametrize("min_df", [1, 2])
def test_tfidf_weights(spark, min_df):
    want, size = brute(min_df)
    v = TF.fit(docs(spark), "id", "text", min_df)
    assert v.size == size
    got = {(r["key"], r["term"], r["term_id"], r["tf"]): r["weight"] for r in TF.weights(docs(spark), "id", "text", v).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_tfidf_vectors_train_a_model(spark):
    from quarry.operators import models as MD

    v = TF.fit(docs(spark), "id", "text")
    rows = TF.vectors(docs(spark), "id", "text", v)
    got = {r["id"]: r["features"] for r in rows.collect()}
    want, size = brute()
    assert len(got) == len(TEXTS) and got[2].size == size and got[2].numNonzeros() == 0
    assert {(i, t): w for (i, _, t, _), w in want.items()} == pytest.approx(
        {(i, int(t)): w for i, x in got.items() for t, w in zip(x.indices, x.values)})
    labelled = rows.withColumn("label", (F.col("id") % 2).cast("double"))
    model = MD.make_estimator("logistic_regression", MD.CLASSIFICATION, MD.data_stats(labelled)).fit(labelled)
    assert model.numFeatures == size


def test_tfidf_of_an_empty_table(spark):
    v = TF.fit(docs(spark).limit(0), "id", "text")
    assert v.size == 0 and TF.weights(docs(spark), "id", "text", v).count() == 0


def test_sparse_one_hot(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, None, "x"), (4, "a-b", "y"), (5, "a_b", "y")], "id int, p string, q string")
    fitted = FE.fit_one_hot(df, ["q", "p"])
    assert {(r["column"], r["value"]): r["index"] for r in fitted.table.collect()} == {
        ("q", "x"): 0, ("q", "y"): 1, ("p", "a"): 2, ("p", "a-b"): 3, ("p", "a_b"): 4, ("p", "b"): 5}
    new = df.unionByName(spark.createDataFrame([(6, "unseen", "y"), (7, None, None)], "id int, p string, q string"))
    got = sorted((r["id"], r["index"], r["value"]) for r in FE.one_hot_entries(new, ["id"], fitted).collect())
    assert got == [(1, 0, 1.0), (1, 5, 1.0), (2, 2, 1.0), (3, 0, 1.0), (4, 1, 1.0), (4, 3, 1.0), (5, 1, 1.0), (5, 4, 1.0), (6, 1, 1.0)]
    vectors = {r["id"]: r["features"] for r in FE.one_hot_vectors(new, "id", fitted).collect()}
    assert vectors[5].size == 6 and list(vectors[5].indices) == [1, 4] and vectors[7].numNonzeros() == 0
    assert FE.one_hot_entries(df, ["id"], FE.fit_one_hot(df, [])).count() == 0
