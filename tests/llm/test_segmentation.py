import collections
import math

import numpy as np
import pytest

from quarry.llm import segmentation as S
from quarry.llm.queries import sentencepiece_model

ODD = [None, "", " ", "a", "the cat", "  two  blanks\n\n\ttabs ", "Größe 中文字符 🙂 עברית", "x" * 3000, "\x00\x01", "end\n",
       "▁already ▁▁ escaped", "The end. " * 4000, "á ﬁ"]


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary(sentencepiece_model())


def paths_of(vocabulary, text):
    """Every segmentation of a short normalised text with its log probability, by recursion."""
    def rest(u):
        if not u:
            return [((), 0.0)]
        out = []
        for j in range(1, min(len(u), vocabulary.longest) + 1):
            if u[:j] in vocabulary.pieces:
                i, lp = vocabulary.pieces[u[:j]]
                out += [((i, *r), lp + s) for r, s in rest(u[j:])]
        if u[0] not in vocabulary.pieces:
            ids = tuple(vocabulary.byte_ids[b] for b in u[0].encode())
            out += [((*ids, *r), vocabulary.rare * len(ids) + s) for r, s in rest(u[1:])]
        return out
    found = rest(text)
    total = math.log(sum(math.exp(s) for _, s in found))
    return {ids: s - total for ids, s in found}


def draw(vocabulary, texts, keys, k, alpha=1.0):
    lat = S.Lattices(vocabulary, alpha)
    starts = [lat.starts(vocabulary.normalise(t)) for t in texts]
    lat.store()
    found = S.sample_paths(lat, [lat.row[s] for s in starts], keys, k)
    return [[(tuple(S._ids(lat, p[0]).tolist()), *p[1:]) for p in paths] for paths in found]


def test_samples_follow_the_lattice_without_replacement(vocabulary):
    text, n = "the cat", 12000
    exact = paths_of(vocabulary, vocabulary.normalise(text))
    first, pairs, weight = collections.Counter(), collections.Counter(), collections.Counter()
    for paths in draw(vocabulary, [text] * n, [i * 7919 + 3 for i in range(n)], 3):
        ids = [p[0] for p in paths]
        assert len(set(ids)) == 3 and [p[2] for p in paths] == sorted((p[2] for p in paths), reverse=True)
        assert all(abs(p[1] - exact[p[0]]) < 1e-9 for p in paths)
        first[ids[0]] += 1
        pairs[ids[0], ids[1]] += 1
        for p in paths:
            weight[p[0]] += 1 / math.exp(p[3]) / n
    likely = sorted(exact, key=exact.get, reverse=True)[:3]
    for a in likely:
        p = math.exp(exact[a])
        assert abs(first[a] / n - p) < 4 * math.sqrt(p / n)
        assert abs(weight[a] - 1) < 0.1  # inverse inclusion scores estimate counts without bias
        for b in likely:
            if a != b:
                q = p * math.exp(exact[b]) / (1 - p)
                assert abs(pairs[a, b] / n - q) < 4 * math.sqrt(q / n) + 1e-4


@pytest.mark.parametrize("text", ["a", "cat", "é\n", "ab c"])
def test_small_lattices_are_listed_whole(vocabulary, text):
    exact = paths_of(vocabulary, vocabulary.normalise(text))
    got = draw(vocabulary, [text], [11], 200)[0]
    assert {p[0] for p in got} == set(exact) and len(got) == len(exact) <= 200
    assert all(p[3] == 0.0 for p in got)


def test_shared_endings_and_table_order(vocabulary):
    """The same samples whether a text's units come alone, late or together with others."""
    texts = ["the other mother", "another brother", "bother the weather\nother"]
    keys = [1, 2, 3]
    together = draw(vocabulary, texts, keys, 4)
    assert together == [draw(vocabulary, [t], [k], 4)[0] for t, k in zip(texts, keys, strict=True)]
    lat = S.Lattices(vocabulary, 1.0)
    for t in texts[::-1]:
        lat.starts(vocabulary.normalise(t))
        lat.store()
    late = S.sample_paths(lat, [lat.row[lat.starts(vocabulary.normalise(t))] for t in texts], keys, 4)
    assert [[tuple(S._ids(lat, p[0]).tolist()) for p in ps] for ps in late] == [[p[0] for p in ps] for ps in together]


def test_units_are_cut_as_the_pattern_says(vocabulary):
    for text in [*ODD, "a\0b c", "\n\nno blank\n end ", "one", "\n", " \n ", "a b" * 500]:
        u = vocabulary.normalise(text or "")
        assert list(vocabulary.cut(u)) == vocabulary.units.findall(u)


def test_a_table_keeps_units_and_a_row_per_rest(vocabulary):
    """Only whole units are named; rests met in several groups have one row, and a cleared table starts anew."""
    lat = S.Lattices(vocabulary, 1.0)
    groups = ["the other mother", "another brother", "bother the weather\nother", "x" * 3000 + " 中文字符🙂 the other"]
    for _ in range(2):
        units, rests = set(), set()
        for text in groups:
            u = vocabulary.normalise(text)
            lat.starts(u)
            lat.store()
            units |= set(vocabulary.cut(u))
            rests |= {x[i:] for x in units for i in range(len(x))}
            assert set(lat.unit) == units and lat.rows == len(rests) == len(lat.link) - 1
        lat.clear()


def test_texts_decode(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (4, "the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as ids", "1 as rank").repartition(3)
    out = S.sample_segmentations(df, "doc_id", "text", sentencepiece_model(), k=3, seed=5)
    got = out.collect()
    assert all(r["round_trip"] == ("▁" not in (dict(rows)[r["doc_id"]] or "")) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["rank"], tuple(r["ids"]), r["n_pieces"]))
    assert set(by) == {None, *range(len(ODD))}
    for i, t in enumerate(ODD):
        copies = 2 if i == 4 else 1  # equal rows get equal samples
        assert len({x[1] for x in by[i]}) * copies == len(by[i]) and max(x[0] for x in by[i]) <= 3
        assert all(vocabulary.sp.decode(list(x[1])) == (t or "") and x[2] == len(x[1]) for x in by[i] if t and "▁" not in t)
    assert by[0] == by[1] == [(1, (), 0)]
    back = {(r["doc_id"], r["rank"]): r["back"] for r in S.decode(out, "ids", "back", sentencepiece_model()).collect()}
    assert all(v == (dict(rows)[i] or "").replace("▁", " ") for (i, _), v in back.items())


def test_batches_do_not_matter(spark):
    df = spark.range(60).selectExpr("id as doc_id", "concat('word', id, ' other ', id * id) as text")
    model = sentencepiece_model()
    a = S.sample_segmentations(df.repartition(5), "doc_id", "text", model, k=2).collect()
    b = S.sample_segmentations(df.coalesce(1), "doc_id", "text", model, k=2).collect()
    c = S.sample_segmentations(df.coalesce(1), "doc_id", "text", model, k=2, seed=9).collect()
    assert sorted(a) == sorted(b) != sorted(c)
    assert S.sample_segmentations(df.limit(0), "doc_id", "text", model).count() == 0


def test_alpha_flattens(vocabulary):
    sharp = draw(vocabulary, ["the cat sat on the mat"] * 300, list(range(300)), 1, alpha=2.0)
    flat = draw(vocabulary, ["the cat sat on the mat"] * 300, list(range(300)), 1, alpha=0.2)
    assert np.mean([len(p[0][0]) for p in sharp]) < np.mean([len(p[0][0]) for p in flat])
