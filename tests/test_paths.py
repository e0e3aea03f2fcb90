"""Reports, training and submission that start from a path."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.plans import automl as A
from quarry.plans import report as RP
from quarry.sources import scan as SC


def put(root, name, text="x"):
    p = os.path.join(root, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)
    return p


@pytest.mark.parametrize("names, want", [
    (["a.txt", "b.jsonl", "c.csv"], "nlp"), (["a.json", "b.json", "c.csv"], "nlp"), (["a.csv", "b.txt"], "tabular"),
    (["a.txt", "b.txt", "deep/c.WEBP"], "vision"), (["README", "a.txt"], "tabular")])
def test_modality_of_folders(spark, tmp_dir, names, want):
    for n in names:
        put(tmp_dir, f"d/{n}")
    assert SC.path_modality(spark, f"{tmp_dir}/d") == want


@pytest.mark.parametrize("name, want", [("a.JPG", "vision"), ("a.txt", "nlp"), ("a.csv", "tabular"), ("a.parquet", "tabular"), ("b.jsonl", "nlp")])
def test_modality_of_files(spark, name, want):
    assert SC.path_modality(spark, f"/x.y/{name}") == want


def sections(df):
    return {r["section"] for r in df.collect()}


def test_report_by_path(spark, tmp_dir):
    put(tmp_dir, "t/one.txt", "some words here\n\nmore words")
    put(tmp_dir, "t/deep/two.TXT", "other words")
    assert "top_words" in sections(RP.report_path(spark, f"{tmp_dir}/t"))
    assert sorted(r["text"] for r in SC.read_text_files(spark, f"{tmp_dir}/t").collect()) == ["other words", "some words here\n\nmore words"]
    assert "top_words" in sections(RP.report_path(spark, f"{tmp_dir}/t/one.txt"))
    table = put(tmp_dir, "c/t.csv", "a,b\n" + "".join(f"{i},{'xy'[i % 2]}\n" for i in range(40)))
    assert "numeric" in sections(RP.report_path(spark, table))
    assert "quality" in sections(RP.strategy_path(spark, table))
    series = put(tmp_dir, "c/s.tsv", "date\tvalue\n" + "".join(f"2024-01-{i:02d}\t{i}.5\n" for i in range(1, 29)))
    assert "stationarity" in sections(RP.report_path(spark, series))
    rows = put(tmp_dir, "c/r.jsonl", "".join(f'{{"a": {i}, "b": {i % 3}}}\n' for i in range(30)))
    assert "numeric" in sections(RP.report_path(spark, rows))
    from test_image_headers import gif
    with open(put(tmp_dir, "i/cat/x.gif"), "wb") as f:
        f.write(gif(3, 4))
    assert sections(RP.report_path(spark, f"{tmp_dir}/i")) == {"class_distribution", "image_stats"}
    with pytest.raises(ValueError):
        RP.strategy_path(spark, f"{tmp_dir}/i")


def test_training_and_submission_by_path(spark, tmp_dir):
    df = spark.range(120).select(F.col("id"), (F.col("id") % 11).alias("x"), ((F.col("id") % 11) * 1.5 + 0.25).alias("target"))
    df.write.parquet(f"{tmp_dir}/train.parquet")
    df.drop("target").write.option("header", True).csv(f"{tmp_dir}/test.csv")
    result = A.auto_train_path(spark, f"{tmp_dir}/train.parquet", "target", models=["linear_regression"], key="id")
    sub, report = A.submission_path(spark, result, f"{tmp_dir}/test.csv")
    assert report.first()["is_valid"] and sub.count() == 120
    got = {r["id"]: r["target"] for r in sub.collect()}
    assert got[3] == pytest.approx(4.75, abs=1e-6)
