"""Contract queries for text profiling on ``documents`` (joined with ``labels``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import text as X
from ..session import ensure_checkpoint_dir
from ..sources.scan import CSV_NA_TOKENS, read_csv, read_table
from .common import lit, rnd, round_doubles
from .registry import register

WS_SQL = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
NON_WORD_SQL = r"[^\p{L}\p{N}_\s\p{Z}\x{1c}-\x{1f}\x{85}]"


def words_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{WS_SQL}+'), lambda w: w <> '')"


def vocab_sql(expr: str) -> str:
    return words_sql(f"regexp_replace(lower({expr}), '{NON_WORD_SQL}', '', 'g')")


WORDS_SQL = f"(SELECT unnest({vocab_sql('text')}) AS word FROM documents)"


def _documents(spark, sf):
    # Tokenising is the CPU-heavy step: spread a small single-file table over all cores.
    docs = read_table(spark, sf, "documents", spread=True)
    return docs, X.detect_text_column(docs)


@register("text_lengths", f"""
SELECT count(*) AS n_texts, {rnd('avg(length(text))')} AS avg_chars,
       CAST(min(length(text)) AS INTEGER) AS min_chars, CAST(max(length(text)) AS INTEGER) AS max_chars,
       {rnd(f'avg(len({words_sql("text")}))')} AS avg_words,
       CAST(min(len({words_sql("text")})) AS INTEGER) AS min_words,
       CAST(max(len({words_sql("text")})) AS INTEGER) AS max_words
FROM documents WHERE text IS NOT NULL""")
def text_lengths(spark, sf):
    docs, t = _documents(spark, sf)
    return round_doubles(X.text_lengths(docs, t))


@register("text_vocab", f"""
SELECT CAST(count(*) AS BIGINT) AS total_words, count(DISTINCT word) AS unique_words
FROM {WORDS_SQL}""")
def text_vocab(spark, sf):
    docs, t = _documents(spark, sf)
    return X.vocabulary(docs, t)


@register("text_top_words", f"""
SELECT word, count(*) AS count FROM {WORDS_SQL} GROUP BY word
ORDER BY count DESC, word LIMIT 20""")
def text_top_words(spark, sf):
    docs, t = _documents(spark, sf)
    return X.top_words(docs, t, 20)


@register("text_top_words_nostop", f"""
SELECT word, count(*) AS count FROM {WORDS_SQL}
WHERE word NOT IN ({', '.join(lit(w) for w in STOP_WORDS)}) AND length(word) > 2
GROUP BY word ORDER BY count DESC, word LIMIT 15""")
def text_top_words_nostop(spark, sf):
    docs, t = _documents(spark, sf)
    return X.top_words_without_stop_words(docs, t, 15)


@register("text_empty", f"""
SELECT count(*) AS n_texts,
       count(*) FILTER (WHERE text IS NULL OR regexp_full_match(text, '{WS_SQL}*')) AS n_empty,
       {rnd(f"count(*) FILTER (WHERE text IS NULL OR regexp_full_match(text, '{WS_SQL}*')) * 100.0 / count(*)")}
         AS empty_pct
FROM documents""")
def text_empty(spark, sf):
    docs, t = _documents(spark, sf)
    return round_doubles(X.empty_texts(docs, t))


@register("text_label_dist", """
WITH j AS (SELECT l.quality FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT CAST(quality AS VARCHAR) AS label, count(*) AS count FROM j
      WHERE quality IS NOT NULL GROUP BY 1)
SELECT label, count, (SELECT count(*) FROM c) AS n_classes FROM c""")
def text_label_dist(spark, sf):
    docs = read_table(spark, sf, "documents")
    labels = read_table(spark, sf, "labels").select("doc_id", "quality")
    joined = docs.join(labels, "doc_id")
    text_col = X.detect_text_column(joined)
    label_col = X.detect_label_column(joined, text_col)
    return X.label_distribution(joined, label_col)


@register("text_word_histogram", f"""
WITH w AS (SELECT CAST(len({words_sql("text")}) AS DOUBLE) AS n FROM documents),
mm AS (SELECT min(n) AS mn, max(n) AS mx FROM w),
b AS (SELECT CASE WHEN mx = mn THEN 0 ELSE CAST(least(floor((n - mn) / (mx - mn) * 50.0), 49) AS INTEGER) END
             AS bin, count(*) AS count
      FROM w, mm WHERE n IS NOT NULL GROUP BY 1),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(50))
SELECT bins.bin, {rnd('mn + bins.bin * ((mx - mn) / 50.0)')} AS bin_lo,
       {rnd('mn + (bins.bin + 1) * ((mx - mn) / 50.0)')} AS bin_hi,
       CAST(coalesce(b.count, 0) AS BIGINT) AS count
FROM bins CROSS JOIN mm LEFT JOIN b ON bins.bin = b.bin""")
def text_word_histogram(spark, sf):
    docs, t = _documents(spark, sf)
    return round_doubles(X.word_count_histogram(docs, t, 50))


# Tables with a text column and how the detection rules apply to each.
TEXT_TABLES = ["documents", "conversations", "benchmark", "pages"]


@register("text_columns", f"""
SELECT 'documents' AS table_name, 'text' AS text_column, 'n_chars' AS label_column,
       {rnd('avg(length(text))')} AS avg_text_length FROM documents
UNION ALL
SELECT 'conversations', 'text', 'role', {rnd('avg(length(text))')} FROM conversations
UNION ALL
SELECT 'benchmark', 'text', 'item_id', {rnd('avg(length(text))')} FROM benchmark
UNION ALL
SELECT 'pages', tc, CASE WHEN tc = 'html' THEN 'url' ELSE 'html' END,
       CASE WHEN tc = 'html' THEN {rnd('lh')} ELSE {rnd('lu')} END
FROM (SELECT CASE WHEN avg(length(url)) > 50 THEN 'url' WHEN avg(length(html)) > 50 THEN 'html'
                  ELSE 'url' END AS tc, avg(length(url)) AS lu, avg(length(html)) AS lh FROM pages)""")
def text_columns(spark, sf):
    """Text and label column chosen by the name / mean-length rules for each text table."""
    from pyspark.sql import functions as F
    out = None
    for t in TEXT_TABLES:
        df = read_table(spark, sf, t)
        text_col = X.detect_text_column(df)
        label_col = X.detect_label_column(df, text_col)
        part = df.agg(F.avg(F.length(text_col)).alias("avg_text_length")).select(
            F.lit(t).alias("table_name"), F.lit(text_col).alias("text_column"),
            F.lit(label_col).alias("label_column"), "avg_text_length")
        out = part if out is None else out.unionByName(part)
    return round_doubles(out)


@register("tfidf_weights", f"""
WITH d AS (SELECT doc_id, unnest({vocab_sql('text')}) AS term FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
v AS (SELECT term, count(*) AS df, row_number() OVER (ORDER BY term) - 1 AS term_id FROM t GROUP BY term),
n AS (SELECT count(text) AS n FROM documents),
r AS (SELECT doc_id, term, term_id, tf, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS raw FROM t JOIN v USING (term), n)
SELECT doc_id, term, term_id, tf, {rnd('raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id))')} AS weight FROM r""")
def tfidf_weights(spark, sf):
    """tf-idf weight of every term of every document, over the exact vocabulary."""
    from ..operators import tfidf as TF

    docs, t = _documents(spark, sf)
    vocabulary = TF.fit(docs, "doc_id", t)
    out = TF.weights(docs, "doc_id", t, vocabulary)
    return round_doubles(out.withColumnRenamed("key", "doc_id"))


@register("csv_round_trip", f"""
SELECT doc_id, CASE WHEN text NOT IN ({", ".join(lit(x) for x in CSV_NA_TOKENS)}) THEN md5(text) END AS text_md5, lang, source, n_chars FROM
  (SELECT doc_id, '"' || lang || '", ' || text || chr(10) || '""' || source AS text, lang, source, n_chars FROM documents)""")
def csv_round_trip(spark, sf):
    """Texts with quotes, delimiters and newlines, written as csv and read again without one task per file."""
    docs = read_table(spark, sf, "documents")
    hard = F.concat(F.lit('"'), F.col("lang"), F.lit('", '), F.col("text"), F.lit("\n"), F.lit('""'), F.col("source"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    docs.select("doc_id", hard.alias("text"), "lang", "source", "n_chars").write.option("header", True).option("escape", '"').csv(path)
    return read_csv(spark, path).select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")
