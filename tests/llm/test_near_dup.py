import collections
import random

import pytest

from conftest import SF0001
from quarry.llm import near_dup
from quarry.llm._common import table
from quarry.llm.queries import QUERIES


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = collections.defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            inverted[x].append(n)
    common = collections.Counter((a, b) for at in inverted.values() for p, a in enumerate(at) for b in at[p + 1:])
    for (a, b), c in common.items():
        (i, x), (j, y) = sets[a], sets[b]
        if None not in (i, j) and 100 * c >= percent * (len(x) + len(y) - c):
            i, j = find(i), find(j)
            parent[max(i, j)] = min(i, j)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets if i is not None)


def run(spark, rows, k=3, similarity=0.85):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as cid", "1 as token", "2 as label")
    got = near_dup.near_duplicates(df.repartition(3), "doc_id", "text", k, similarity).collect()
    assert len(got) == len(rows)
    return sorted(tuple(r) for r in got if r["doc_id"] is not None), [r for r in got if r["doc_id"] is None]


def mutated(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"m{rng.randrange(8)}"
    return " ".join(out)


@pytest.mark.parametrize("k,similarity", [(3, 0.85), (5, 0.8)])
def test_against_brute_force(spark, k, similarity):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    bases = [[word() for _ in range(n)] for n in (150, 80, 40, 12)]
    texts = [mutated(rng, rng.choice(bases), rng.randrange(9)) for _ in range(260)]  # copies around the threshold
    passage = " ".join(word() for _ in range(50))
    texts += [" ".join(word() for _ in range(20)) + " " + passage for _ in range(40)]  # share a passage, are not alike
    texts += [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += ["", None, "  \n", "one", "ONE", "two words", "two\twords", "\x0b", "é É", "a b c", "A B C", "x " * 30000, "x " * 20000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = list(zip(order, texts, strict=True))
    rows += [rows[5], rows[5]]  # repeated rows
    got, _ = run(spark, rows, k, similarity)
    assert got == brute(rows, k, round(similarity * 100))
    assert len({r[2] for r in got}) < len(got)


def test_null_ids_ties_and_empty(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (None, "no one else"), (9, "a b c d"), (None, None)]
    got, unnamed = run(spark, rows)
    assert got == [(4, 2, 4, True), (9, 2, 4, False)]
    assert sorted((r["n_shingles"], r["component_id"], r["kept"]) for r in unnamed if r["n_shingles"] != 2) == [(0, None, True), (1, None, True)]
    assert [(r["component_id"], r["kept"]) for r in unnamed if r["n_shingles"] == 2] == [(4, False)]
    assert run(spark, []) == ([], [])


def test_threshold_is_a_tail_bound():
    assert near_dup.match_threshold(0.85, 64) == 39 and near_dup.match_threshold(1.0, 64) == 64
    assert near_dup.match_threshold(0.85, 64, 1e-3) > 39


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 205), (205, 101), (300, 301)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["label"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 205: 100, 301: 300}


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((40, 25), (200, 180), (30, 200)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(0, x) for x in range(n, n + 30)]
        label = {x: x for e in edges for x in e}
        for _ in label:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        found = near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(found) == len({r["node"] for r in found})
        assert {r["node"]: r["label"] for r in found} == {x: y for x, y in label.items() if x != y}


def test_components_stop_at_stars(spark, monkeypatch):
    """Edges that lead to the smallest node need no round, and what a round makes of others no second one."""
    written, real = [], near_dup.write_stage
    monkeypatch.setattr(near_dup, "write_stage", lambda df, name: written.append(name) or real(df, name))
    for edges, rounds in (([], 0), ([(5, 1), (1, 7), (5, 1), (2, 2), (9, 3)], 0), ([(1, 2), (2, 3)], 1)):
        written.clear()
        got = sorted(tuple(r) for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect())
        assert got == {0: [], 5: [(5, 1), (7, 1), (9, 3)], 2: [(2, 1), (3, 1)]}[len(edges)]
        assert len(written) == 1 + rounds


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF0001, "documents").collect()]
    got = sorted(tuple(r) for r in QUERIES["op7_near_dup"](spark, SF0001).collect())
    assert got == brute(rows, 3, 85)


def test_few_texts_are_held_at_once(spark, monkeypatch):
    """A large Arrow batch is worked on in slices, with the same rows as small batches."""
    import pyarrow as pa

    docs = spark.createDataFrame([(1, "a b c")], "id long, text string")
    made, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: made.append(f) or real(self, f, *a, **b))
    near_dup._signatures(docs, "id", "text", 3, 64)
    near_dup._sets(docs, "id", "text", 3, docs.selectExpr("id as cid"))
    texts = [None if i % 7 == 0 else f"word{i % 50} and {i} other words" for i in range(1300)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(1300)), "text": texts})
    assert len(made) == 2
    for f in made:
        out = list(f(iter([batch, batch.slice(0, 0)])))
        assert max(b.num_rows for b in out) <= near_dup.ROWS_TOGETHER < 1300
        one_by_one = [r for i in range(1300) for b in f(iter([batch.slice(i, 1)])) for r in b.to_pylist()]
        assert [r for b in out for r in b.to_pylist()] == one_by_one
