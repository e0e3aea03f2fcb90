import numpy as np
import pytest

from conftest import SF001
from quarry.llm import quality
from quarry.llm._common import fold, labelled_sample, one_label, table
from quarry.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF001, "labels").collect()}
    rows = QUERIES["op2_quality"](spark, SF001).collect()
    assert len(rows) == table(spark, SF001, "documents").count()
    held = [r for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95
    good = [r["predicted"] for r in held if labels[r["doc_id"]] == 1]
    assert np.mean(good) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_fit_is_the_discriminant_of_the_training_rows(spark):
    """Against means, covariances and densities from NumPy over the same rows."""
    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    model = quality.fit(docs, labels, "doc_id", "text", pooling=0.2, ridge=0.1)
    train = docs.join(labels, "doc_id").where(fold(docs["doc_id"], 5) != 0).select("text", "quality").collect()
    x, y = np.array([quality.statistics(r["text"]) for r in train]), np.array([r["quality"] for r in train])
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    n, d = [(y == c).sum() for c in (0, 1)], x.shape[1]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    dens = []
    for c in (0, 1):
        share = max(0.2, (d + 1) / (n[c] + d + 1))
        s = 0.9 * ((1 - share) * cov[c] + share * pooled) + 0.1 * np.diag(np.diag(pooled))
        z = x - x[y == c].mean(0)
        dens.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) + np.linalg.slogdet(s)[1]) + np.log(n[c]))
    want = 1 / (1 + np.exp(-np.clip(dens[1] - dens[0], -40, 40)))
    assert np.allclose(model.scores(x), want, atol=1e-6)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (None, "a b"), (5, "x" * 3_000_000), (5, "w. " * 900_000),
                                  (6, "\x00é🙂")], "doc_id long, text string").selectExpr("*", "'z' as score", "0 as _y")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (6, 1, 0), (6, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, "doc_id", "text").collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert {tuple(r) for r in one_label(labels, "doc_id", "quality").collect()} == {(1, 1), (2, 0)}
    assert labelled_sample(labels, "doc_id", "quality", 5, 0, 1).count() == 1
    assert quality.classify(docs.limit(0), labels, "doc_id", "text").count() == 0
    none = quality.classify(docs, labels.limit(0), "doc_id", "text").collect()
    assert {r["score"] for r in none} == {0.5}


@pytest.mark.parametrize("text", [None, "", "a", "é " * 10])
def test_statistics_are_finite(text):
    assert np.isfinite(quality.statistics(text)).all() and len(quality.statistics(text)) == len(quality.STATISTICS)


def test_long_texts_are_counted_whole():
    text = "one two three, FOUR 5\n" * 200_000
    short = quality.statistics(text[:len(text) // 2])
    long = quality.statistics(text)
    some = [0, 1, 3]  # shares that are not zero do not change with the length
    assert np.allclose(np.array(long)[some], np.array(short)[some], atol=0.01)
