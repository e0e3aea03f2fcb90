"""Quoted newlines in csv files that are split anywhere, against Python's csv module."""

import csv
import os
import random

import pytest

from quarry.sources import scan as SC


def write(path, rows, **kw):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator="\n", **kw).writerows(rows)


@pytest.mark.parametrize("split", ["128m", "64", "7"])
def test_equal_to_csv_module(spark, tmp_dir, split):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["a", 'say "hi"', "x,y", "two\nlines", "\n", '"', "é\n\n\"\n", "plain text", "1,2\n3"])
    folder = os.path.join(tmp_dir, "t.csv")
    os.makedirs(folder)
    want = []
    for k in range(3):
        rows = [[f"{k}-{i}", word() + word(), word()] for i in range(25)]
        want += rows
        write(os.path.join(folder, f"f{k}.csv"), [["id", "t", "u"], *rows])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = sorted(list(r) for r in SC.read_csv(spark, folder).select("id", "t", "u").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(want)


def test_newline_keeps_types_and_missing_values(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t.csv")
    write(path, [["k", "v", "t"], ["1", "2.5", "x\ny"], ["2", "NA", "z"], ["3", "", "NA"]])
    df = SC.read_csv(spark, path)
    assert dict(df.dtypes) == {"k": "bigint", "v": "double", "t": "string"}
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(1, 2.5, "x\ny"), (2, None, "z"), (3, None, None)]


def test_windows_lines_and_an_open_quote(spark, tmp_dir):
    path = os.path.join(tmp_dir, "w.csv")
    with open(path, "w", newline="") as f:
        f.write('k,t\r\n1,"a\r\nb"\r\n2,c\r\n')
    assert sorted(tuple(r) for r in SC.read_csv(spark, path).collect()) == [(1, "a\r\nb"), (2, "c")]
    with open(path, "w", newline="") as f:
        f.write('k,t\n1,a\n2,"open\nend\n')
    assert [r["k"] for r in SC.read_csv(spark, path).orderBy("k").collect()] == [1, 2]


def test_one_file_is_read_by_several_tasks(spark, tmp_dir):
    path = os.path.join(tmp_dir, "big.csv")
    write(path, [["k", "t"]] + [[i, f"row\n{i}"] for i in range(500)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        records = SC.csv_records(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 2
        assert records.count() == 501
        assert SC.read_csv(spark, path).where("t = concat('row\n', k)").count() == 500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
