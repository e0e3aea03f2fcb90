import random
import re

import duckdb
import pytest

from conftest import SF001
from quarry.llm import decontaminate
from quarry.llm.queries import ORACLES, QUERIES


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, window=20, agree=0.8, masks=decontaminate.MASKS):
    out = set()
    for i, text in docs:
        d = words(text)
        for j, item in items:
            b = words(item)
            best = None
            for start in range(-len(b), len(d)):
                same = [0 <= start + x < len(d) and d[start + x] == w for x, w in enumerate(b)]
                seeded = any(x + len(m) <= len(b) and start + x >= 0 and start + x + len(m) <= len(d)
                             and all(same[x + y] for y, on in enumerate(m) if on == "1") for m in masks for x in range(len(b)))
                size = min(window, len(b))
                if seeded and (most := max(sum(same[x:x + size]) for x in range(len(b) - size + 1))) >= agree * size:
                    if best is None or most > best[0]:
                        best = (most, size, start)
            if best:
                out.add((i, j, *best))
    return out


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item", "2 as id", "3 as place")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"], r["matched"], r["window"], r["start"])
            for r in decontaminate.overlaps(d, "doc_id", "text", b, "item_id", "text", **options).collect()}


def test_against_brute_force(spark):
    rng = random.Random(2)
    item = lambda n: [f"w{rng.randrange(90)}" for _ in range(n)]
    items = [item(n) for n in (5, 8, 14, 30, 59)]
    docs = []
    for i in range(80):
        b = list(rng.choice(items))
        for _ in range(rng.randrange(12)):
            b[rng.randrange(len(b))] = "zz"
        part = b[:rng.randrange(1, len(b) + 1)] if i % 3 == 0 else b
        docs.append((i, ", ".join(item(rng.randrange(20))) + " " + " ".join(part).upper() + "!\n" + " ".join(item(rng.randrange(20)))))
    docs += [(500, None), (501, ""), (502, "..."), (None, " ".join(items[3])), (7, " ".join(items[2])), (7, " ".join(items[2]))]
    b = [(n, " ".join(x)) for n, x in enumerate(items)] + [(9, None), (10, ""), (3, " ".join(items[3]))]
    got = run(spark, docs, b)
    assert got == brute(docs, b) and len(got) > 30


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = [(1, "a b c d e f g h i j k l"), (2, "nothing of it")]
    items = [(1, "a b c x e f g h i j k l")]
    want = run(spark, docs, items)
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", -1)
    assert run(spark, docs, items) == want == {(1, 1, 11, 12, 0)}


@pytest.mark.parametrize("docs,items", [([], [(1, "a b c d e f g h")]), ([(1, "a b c d e f g h")], [])])
def test_empty(spark, docs, items):
    assert run(spark, docs, items) == set()


def test_clean_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i", "x"), (1, "other", "y"), (None, "a b c d e f g h i", "z"), (None, None, "n")],
                                 "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    found = decontaminate.overlaps(docs, "doc_id", "text", items, "item_id", "text")
    left = decontaminate.clean(docs, "doc_id", "text", found)
    assert left.columns == docs.columns and sorted(r["source"] for r in left.collect()) == ["n", "y"]


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF001}/{t}.parquet'")
    want = con.execute(ORACLES["op8_decontaminate"]).fetchall()
    got = [tuple(r) for r in QUERIES["op8_decontaminate"](spark, SF001).collect()]
    assert sorted(got) == sorted(want) and got
