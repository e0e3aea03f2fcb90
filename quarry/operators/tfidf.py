"""tf-idf with an exact vocabulary.

Terms are the tokens of :func:`functions.text.vocab_tokens`. A document's weight of a term is
``tf * (ln((1 + n) / (1 + df)) + 1)``, and its weights are divided by their Euclidean length; ``n``
counts the rows with a text, ``df`` the ones that hold the term. The vocabulary is every term in at
least ``min_df`` documents, numbered in term order by a distributed row index, so no two terms share
an id (as hashed ids do) and its size has no bound that the driver sets.

Documents are rows of a unique key. Texts are dealt by key, shuffled once as they are; their terms are
counted where a text lies, and frequent terms meet a broadcast part of the vocabulary there, so that of
the many more (document, term) rows only those of rare terms are shuffled. NULL and empty
texts, and texts of unknown terms, have no weights; :func:`vectors` gives them an empty vector.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import c
from ..functions.text import vocab_split
from ..session import cut_lineage
from .features import lookup
from .ordering import row_index

TEXT_BYTES = 16 << 20  # text of one shuffle partition: its terms take several times as much


@dataclass
class Vocabulary:
    """(term, term_id, df), the number of terms and the number of documents it was fitted on."""
    terms: DataFrame
    size: int
    n_docs: int


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)"""
    texts = df.where(c(text).isNotNull()).select(c(key).alias("key"), c(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TEXT_BYTES + 1)
    rows = texts.repartition(parts, "key").select("key", F.explode(vocab_split(F.col("text"))).alias("term"))
    return rows.where("term != ''").groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))


def fit(df: DataFrame, key: str, text: str, min_df: int = 1) -> Vocabulary:
    """Document frequencies and ids of all terms."""
    seen = term_counts(df, key, text).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    terms = cut_lineage(row_index(cut_lineage(seen), ["term"], out="term_id"))
    return Vocabulary(terms, terms.count(), df.where(c(text).isNotNull()).count())


def weights(df: DataFrame, key: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """(key, term, term_id, tf, weight) of every term of every document that the vocabulary knows."""
    idf = F.log((1.0 + F.lit(vocabulary.n_docs)) / (1.0 + F.col("df"))) + 1.0
    rows = lookup(term_counts(df, key, text), vocabulary.terms, ["term"], "df").withColumn("raw", F.col("tf") * idf)
    w = Window.partitionBy("key")  # where the whole vocabulary was broadcast, texts lie by key already
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(w))
    return rows.where(F.col("key").isNotNull()).select("key", "term", "term_id", "tf", (F.col("raw") / norm).alias("weight"))


def vectors(df: DataFrame, key: str, text: str, vocabulary: Vocabulary, out: str = "features") -> DataFrame:
    """``df`` with a sparse vector of its weights, as long as the vocabulary."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    size = vocabulary.size
    made = F.udf(lambda ids, values: SparseVector(size, ids or [], values or []), VectorUDT())
    lists = weights(df, key, text, vocabulary).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("term_id", "weight"))).alias("__w"))
    joined = df.join(lists.withColumnRenamed("key", "__key"), c(key) == F.col("__key"), "left")
    return joined.withColumn(out, made(F.col("__w.term_id").cast("array<int>"), F.col("__w.weight"))).drop("__key", "__w")
