"""Text operators: Unicode token rule equals Python's str.split / re."""

import re
from collections import Counter

from pyspark.sql import functions as F

from quarry.functions.text import vocab_tokens, words
from quarry.operators import text as X

SAMPLES = ["Hello, woŕld a_b ½ हिंदी x　y z w\x1fq  café!",
           "  \t", "Der Fußball-Verein spielt; l'été est chaud.", "x"]


def test_tokens_match_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "t string")
    got = [r["v"] for r in df.select(vocab_tokens(F.col("t")).alias("v")).collect()]
    want = [re.sub(r"[^\w\s]", "", s.lower()).split() for s in SAMPLES]
    assert got == want
    got_w = [r["w"] for r in df.select(words(F.col("t")).alias("w")).collect()]
    assert got_w == [s.split() for s in SAMPLES]


def test_vocabulary_and_top_words(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "text string")
    all_words = re.sub(r"[^\w\s]", "", " ".join(SAMPLES).lower()).split()
    v = X.vocabulary(df, "text").first()
    assert v["total_words"] == len(all_words) and v["unique_words"] == len(set(all_words))
    top = X.top_words(df, "text", 3).collect()
    counts = Counter(all_words)
    assert [r["count"] for r in top] == sorted(counts.values(), reverse=True)[:3]


def test_empty_texts_count_null_and_blank(spark):
    df = spark.createDataFrame([("  \t",), (None,), ("x",)], "text string")
    assert X.empty_texts(df, "text").first()["n_empty"] == 2


def test_text_and_label_detection(spark):
    df = spark.createDataFrame([(1, "short", "a" * 80, 0)], "id int, name string, body2 string, y int")
    assert X.detect_text_column(df) == "body2"
    assert X.detect_label_column(df, "body2") == "y"
