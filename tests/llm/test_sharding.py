import hashlib
import math
import zlib

import pytest

from quarry.llm import sharding


def expected(key, weights):
    def score(s):
        u = (int(hashlib.md5(f"{key}#{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13
        return (-math.log(u) / weights[s], s)
    return min(map(score, range(len(weights))))[1]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {i % 7} é" * (i % 5), "k") for i in range(3000)] + [(None, None, "n")] * 5 + [(7, "same", "s")] * 400
    return spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(7)


@pytest.mark.parametrize("weights", [[1.0] * 16, [1.0, 2.0, 0.5]])
def test_against_brute_force(docs, weights):
    got = sharding.shard_records(docs, "doc_id", "text", weights).collect()
    assert len(got) == 3405
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == expected(key, weights) and r["grown_shard"] == expected(key, [*weights, 1.0])
        assert r["grown_shard"] in (r["shard"], len(weights)) and r["law"] == "key"
    texts = sorted(((t or "").encode() for t in docs.toPandas().text))
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len(t) + 1, zlib.crc32(t)) for t in texts)
    for s in range(len(weights)):
        mine = sorted((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got if r["shard"] == s)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1] for m in mine] == sorted(m[1] for m in mine)


def test_weights_set_the_shares(spark):
    ids = spark.range(20000).selectExpr("id as doc_id", "cast(id as string) as text")
    n = {r["shard"]: r["count"] for r in sharding.shard_records(ids, "doc_id", "text", [1.0, 3.0]).groupBy("shard").count().collect()}
    assert abs(n[1] / 20000 - 0.75) < 0.02


def test_empty_table_and_bad_weights(spark, docs):
    assert sharding.shard_records(docs.limit(0), "doc_id", "text", [1.0, 1.0]).count() == 0
    one = sharding.shard_records(docs.limit(5), "doc_id", "text", [1.0], grown_weight=None).collect()
    assert {r["shard"] for r in one} == {0} and {r["grown_shard"] for r in one} == {None}
    with pytest.raises(ValueError):
        sharding.shard_records(docs, "doc_id", "text", [1.0, 0.0])
