import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF001
from quarry.llm import toxicity
from quarry.llm._common import table
from quarry.llm.queries import QUERIES

TERMS = ["scum", "idiot", "moron", "worthless", "disgusting", "abominable", "añb"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(TERMS), st.lists(st.tuples(st.integers(0, 12), st.sampled_from(["", "x", "o", "s", "ss"])), max_size=3))
def test_trie_intersection_is_the_edit_distance(term, edits):
    word = term
    for at, c in edits:
        at = min(at, len(word))
        word = word[:at] + c + word[at + 1:] if len(c) < 2 else word[:at] + c + word[at:]
    near = [(distance(word, t), t) for t in TERMS if distance(word, t) <= toxicity.allowed_errors(len(t))]
    want = min(near)[::-1] if near else None
    assert toxicity.Trie(TERMS).match(word) == want


def test_context_separates_quotation_from_abuse():
    s = toxicity.Scorer(toxicity.Lexicon({"idiot": 0.95, "moron": 0.95}, {1: 0.8}))
    abuse, quoted = s.score("you are an idiot and nothing else"), s.score('the "idiot" line in the play')
    told, miss = s.score("the word idiot comes from Greek"), s.score("you are an idiiot")
    assert abuse > 0.9 and quoted < 0.4 and told < 0.4 and 0.7 < miss < abuse
    assert s.score("1d10t") > 0.7 and s.score("all is well") == s.score(None) == s.score("") == 0.01
    assert s.score("idiot moron") > abuse


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF001, "labels").collect()}
    rows = QUERIES["op4_toxicity"](spark, SF001).collect()
    assert len(rows) == table(spark, SF001, "documents").count()
    held = [r for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.93
    assert np.mean([r["predicted"] for r in held if labels[r["doc_id"]] == 0]) < 0.02


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, f"w{i} is a badword{'s' if i % 4 == 0 else ''} w{i + 1} here" if i % 5 == 0 else f"w{i} is fine w{i + 1} here")
            for i in range(400)]
    copies = [(1000 + i, "one copied sentence with rareword inside") for i in range(50)]
    labels = [(i, int(i % 5 == 0)) for i in range(400)] + [(1000 + i, 1) for i in range(50)] + [(None, 1), (3, None)]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_lexicon_needs_contexts_not_copies(spark, tables):
    lexicon = toxicity.learn(*tables, "doc_id", "text")
    assert "badword" in lexicon.terms and "rareword" not in lexicon.terms and "here" not in lexicon.terms


def test_odd_rows(spark, tables):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a badword"), (5, "badword"), (5, "badword"),
                                  (6, "x " * 400_000 + "badvord")], "doc_id long, text string").selectExpr("*", "1 as score")
    train, labels = tables
    lexicon = toxicity.learn(train, labels, "doc_id", "text")
    scorer = toxicity.Scorer(lexicon)
    assert scorer.score("x " * 400_000 + "badword") == scorer.score("badword") > 0.7
    got = toxicity.classify(docs, labels, "doc_id", "text").collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.classify(docs.limit(0), labels.limit(0), "doc_id", "text").count() == 0
