"""Scans and sinks: CSV missing tokens and type narrowing, text lines, parquet / CSV sinks."""

import os

from quarry.sources import scan as SC


def test_csv_na_tokens_and_types(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t.csv")
    with open(path, "w") as f:
        f.write("id,x,when,name,flag\n1,1.5,2024-01-01 00:00:00,a,true\n2,NA,2024-01-02 00:00:00,nan,false\n"
                "3,nan,,b,true\n4,2,2024-01-04 00:00:00,N/A,\n")
    df = SC.read_csv(spark, path)
    types = dict(df.dtypes)
    assert types == {"id": "bigint", "x": "double", "when": "timestamp", "name": "string", "flag": "boolean"}
    rows = df.orderBy("id").collect()
    assert rows[1]["x"] is None and rows[2]["x"] is None and rows[1]["name"] is None
    assert rows[3]["name"] is None and rows[2]["when"] is None and rows[3]["flag"] is None


def test_csv_words_times_and_quotes_stay_strings(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t.tsv")
    with open(path, "w") as f:
        f.write('a\tb\tc\td\nyes\t12:30\t"say ""hi"""\tTRUE\nno\t12:45\tx,y\tfalse\n')
    df = SC.read_path(spark, path)
    assert dict(df.dtypes) == {"a": "string", "b": "string", "c": "string", "d": "boolean"}
    assert [tuple(r) for r in df.orderBy("b").collect()] == [("yes", "12:30", 'say "hi"', True), ("no", "12:45", "x,y", False)]


def test_paths_are_read_by_suffix(spark, tmp_dir):
    import pytest
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    SC.write_parquet(df, os.path.join(tmp_dir, "t.parquet"))
    df.write.json(os.path.join(tmp_dir, "t.jsonl"))
    df.write.option("header", True).csv(os.path.join(tmp_dir, "t.csv"))
    for name in ("t.parquet", "t.jsonl", "t.csv"):
        assert sorted(tuple(r) for r in SC.read_path(spark, os.path.join(tmp_dir, name)).select("k", "v").collect()) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        SC.read_path(spark, os.path.join(tmp_dir, "t.xyz"))


def test_modality_of_folders(spark, tmp_dir):
    for folder, names, want in (("i", ["a.txt", "b/c.PNG"], "vision"), ("n", ["a.txt", "b.txt", "c.csv"], "nlp"), ("t", ["a.csv", "b.txt"], "tabular")):
        for n in names:
            p = os.path.join(tmp_dir, folder, n)
            os.makedirs(os.path.dirname(p), exist_ok=True)
            with open(p, "w") as f:
                f.write("x")
        assert SC.path_modality(spark, os.path.join(tmp_dir, folder)) == want


def test_text_lines(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t.txt")
    with open(path, "w") as f:
        f.write("first line\nsecond\n")
    df = SC.read_text_lines(spark, path)
    assert [r["text"] for r in df.collect()] == ["first line", "second"]


def test_sinks_refuse_overwrite(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    SC.write_parquet(df, os.path.join(tmp_dir, "p"))
    SC.write_csv(df, os.path.join(tmp_dir, "c"))
    assert spark.read.parquet(os.path.join(tmp_dir, "p")).count() == 1
    import pytest
    with pytest.raises(Exception):
        SC.write_parquet(df, os.path.join(tmp_dir, "p"))


def test_nan_normalised_at_scan(spark, tmp_dir):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    p = os.path.join(tmp_dir, "n")
    df.write.parquet(p)
    assert SC.read_parquet(spark, p).where("x IS NULL").count() == 1


def test_spread_small_only_when_fewer_partitions_than_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert SC.spread_small(one).rdd.getNumPartitions() == cores
    many = spark.range(100).repartition(cores * 2)
    assert SC.spread_small(many).rdd.getNumPartitions() == cores * 2


def test_cluster_conf_sizes_partitions():
    from quarry.session import cluster_conf
    small = cluster_conf(8)
    assert small["spark.sql.shuffle.partitions"] == "200"
    big = cluster_conf(16000, 100 * 10**12)
    assert int(big["spark.sql.shuffle.partitions"]) >= 48000
    assert big["spark.ui.enabled"] == "false" and big["spark.sql.adaptive.enabled"] == "true"
