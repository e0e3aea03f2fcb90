"""Text-corpus profiling (A20-A24, P9, V7 text/label rules).

Tokens are exploded and counted with a map-side partial aggregation, so a
word that is a third of all tokens is combined before it is shuffled; nothing
is ever concatenated into one string (the reference joins every text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TEXT_COLUMN_PREFERENCE, TEXT_LABEL_NAMES, c, categorical_columns
from ..functions.text import STOP_WORDS, is_blank, vocab_split, word_count


def detect_text_column(df: DataFrame, min_avg_len: float = 50.0) -> str:
    """Known text names in order; else the first string column whose mean length
    exceeds 50 (one aggregation over all string columns); else the first string
    column; else the first column."""
    for name in TEXT_COLUMN_PREFERENCE:
        if name in df.columns:
            return name
    strings = categorical_columns(df)
    if strings:
        row = df.agg(*[F.avg(F.length(c(s))).alias(f"l{i}") for i, s in enumerate(strings)]).first()
        for i, s in enumerate(strings):
            if row[f"l{i}"] is not None and row[f"l{i}"] > min_avg_len:
                return s
        return strings[0]
    return df.columns[0]


def detect_label_column(df: DataFrame, text_col: str) -> str | None:
    """Known label names in order; else the last column that is not the text."""
    for name in TEXT_LABEL_NAMES:
        if name in df.columns:
            return name
    if len(df.columns) > 1:
        for name in reversed(df.columns):
            if name != text_col:
                return name
    return None


def text_lengths(df: DataFrame, text_col: str) -> DataFrame:
    """avg/min/max characters and whitespace words per text."""
    t = c(text_col)
    chars, wc = F.length(t), word_count(t)
    return df.where(t.isNotNull()).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.avg(chars).alias("avg_chars"), F.min(chars).alias("min_chars"),
        F.max(chars).alias("max_chars"), F.avg(wc).alias("avg_words"),
        F.min(wc).alias("min_words"), F.max(wc).alias("max_words"))


def word_counts(df: DataFrame, text_col: str, stop_words=None, min_len: int = 0) -> DataFrame:
    """(word, count) over the whole corpus, optionally without stop words and short words."""
    words = df.select(F.explode(vocab_split(c(text_col))).alias("word")).where(F.col("word") != "")
    if stop_words:
        words = words.where(~F.col("word").isin(list(stop_words)))
    if min_len:
        words = words.where(F.length("word") > F.lit(min_len))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def vocabulary(df: DataFrame, text_col: str) -> DataFrame:
    """total and unique words after lower-casing and punctuation removal."""
    wc = word_counts(df, text_col)
    return wc.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total_words"),
                  F.count(F.lit(1)).alias("unique_words"))


def top_words(df: DataFrame, text_col: str, k: int = 20, stop_words=None,
              min_len: int = 0) -> DataFrame:
    """Most common words, count desc then word asc."""
    wc = word_counts(df, text_col, stop_words, min_len)
    top = wc.orderBy(F.col("count").desc(), F.col("word").asc()).limit(k)
    return top


def top_words_without_stop_words(df: DataFrame, text_col: str, k: int = 15) -> DataFrame:
    """Top words after the 51-word stop list and the length > 2 rule."""
    return top_words(df, text_col, k, STOP_WORDS, 2)


def empty_texts(df: DataFrame, text_col: str) -> DataFrame:
    """Blank or missing texts, count and percent of rows."""
    t = c(text_col)
    return df.agg(F.count(F.lit(1)).alias("n_texts"),
                  F.count_if(is_blank(t)).alias("n_empty")) \
        .withColumn("empty_pct", F.try_divide(F.col("n_empty") * 100.0, F.col("n_texts")))


def label_distribution(df: DataFrame, label_col: str) -> DataFrame:
    """(label, count, n_classes) of a text label column."""
    counts = (df.where(c(label_col).isNotNull())
              .groupBy(c(label_col).cast("string").alias("label"))
              .agg(F.count(F.lit(1)).alias("count")))
    k = counts.count()
    return counts.withColumn("n_classes", F.lit(k).cast("bigint"))


def word_count_histogram(df: DataFrame, text_col: str, bins: int = 50) -> DataFrame:
    """Distribution of words per text in equal-width bins (A27, 50 bins for word counts)."""
    from .profile import histogram
    return histogram(df.select(word_count(c(text_col)).alias("n_words")), "n_words", bins)
