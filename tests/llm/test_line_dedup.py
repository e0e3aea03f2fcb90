import collections

import duckdb
import pytest

from conftest import SF001
from quarry.llm import line_dedup
from quarry.llm.queries import ORACLES, QUERIES


def brute(rows, ratio, least):
    pages = collections.defaultdict(set)
    for _, host, text in rows:
        pages[host or ""].add(text or "")
    bad = {}
    for host, texts in pages.items():
        n = collections.Counter(x for t in texts for x in set(t.split("\n")) if x.strip(" "))
        bad[host] = {x for x, c in n.items() if c >= least and c > ratio * len(texts)}
    out = []
    for i, host, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if x not in bad[host or ""]]
        out.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def check(spark, rows, ratio=0.3, least=2):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "7 as n_lines", "1 as mark")
    got = line_dedup.drop_lines(df, "source", "text", ratio, least)
    assert got.columns == [*df.columns, "_lines", "_dropped"]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["text"], r["_lines"], r["_dropped"]) for r in got.collect()), key=key) == sorted(brute(rows, ratio, least), key=key)


def test_against_brute_force(spark):
    rows = [(i, f"h{i % 3}", "\n".join(["menu", f"line {i}", "menu" if i % 2 else "", f"tail {i % 4}", "  "])) for i in range(40)]
    rows += [(100 + i, "h0", "copied page\nits own lines") for i in range(60)]  # copies are no boilerplate
    rows += [(200, None, "a\nb"), (201, None, "a\nc"), (202, None, None), (203, "h0", ""), (None, "h1", "menu\nx"), (204, "one", "alone"),
             (205, "h2", "\n".join(f"l{j}" for j in range(20000)) + "\nmenu"), (5, "h2", "line 5"), (5, "h2", "line 5")]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "h", "\n\n")]])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_clashing_names_are_refused(spark):
    with pytest.raises(ValueError):
        line_dedup.drop_lines(spark.createDataFrame([(1, "h", "t", 1)], "doc_id long, source string, text string, _bad int"), "source", "text")


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF001}/documents.parquet'")
    want = con.execute(ORACLES["op3_line_dedup"]).fetchall()
    got = QUERIES["op3_line_dedup"](spark, SF001).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and sum(r["n_dropped"] for r in got) > 0
