"""The ``opN_`` queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def tokenizer_source(name: str) -> str:
    """Content of a public tokenizer file, read on the driver (executors get it by broadcast)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@_query("op1_token_counts")
def op1_token_counts(spark, sf):
    """Tokens of every whole text of ``documents`` under the 50k byte-level BPE tokenizer."""
    from . import token_counts

    return token_counts.count_tokens(table(spark, sf, "documents"), "doc_id", "text",
                                     tokenizer_source("byte_bpe_50k.json"), limit=1024)


_OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""


@_query("op5_topk_search", _OP5_SQL)
def op5_topk_search(spark, sf):
    """Ten best inner products of every vector whose id is divisible by 100, against all rows."""
    from . import topk

    rows = topk.quantised(table(spark, sf, "embeddings"), "vec_id", "embedding", 1024)
    return topk.top_k(rows, rows.where(F.col("id") % 100 == 0), 10)


@_query("op6_sharding")
def op6_sharding(spark, sf):
    """All ``documents`` in 16 equal shards by rendezvous hashing of ``doc_id`` (law ``key``)."""
    from . import sharding

    return sharding.shard_records(table(spark, sf, "documents"), "doc_id", "text", [1.0] * 16)


@_query("op10_chat_format")
def op10_chat_format(spark, sf):
    """Digests of all formatted ``conversations`` and of conversation -1, read from the output."""
    from . import chat

    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id bigint, turn bigint, role string, text string")
    turns = chat.format_turns(rows.unionByName(extra), "conv_id", "turn", "role", "text")
    return chat.read_back(turns, "conv_id")


@_query("op2_quality")
def op2_quality(spark, sf):
    """Quality scores of every whole text of ``documents``, learned from ``labels.quality``."""
    from . import quality

    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "text")


_OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(coalesce(text, ''), chr(10)) AS lines
           FROM documents),
p AS (SELECT DISTINCT host, coalesce(text, '') AS text, lines FROM d),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
l AS (SELECT host, line, count(*) AS n
      FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) WHERE trim(line) <> '' GROUP BY host, line),
b AS (SELECT host, list(line) AS bad FROM l JOIN t USING (host) WHERE n >= 5 AND n > 0.001 * pages GROUP BY host),
k AS (SELECT d.*, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept
      FROM d LEFT JOIN b USING (host))
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS BIGINT) AS n_lines,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END AS BIGINT) AS n_dropped
FROM k"""


@_query("op3_line_dedup", _OP3_SQL)
def op3_line_dedup(spark, sf):
    """``documents`` without the lines that stand in over a thousandth of their source's pages."""
    from . import line_dedup

    out = line_dedup.drop_lines(table(spark, sf, "documents"), "source", "text", ratio=0.001, min_pages=5)
    return out.select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))


@_query("op4_toxicity")
def op4_toxicity(spark, sf):
    """Toxicity scores of every whole text of ``documents``, learned from ``labels.toxic``."""
    from . import toxicity

    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "text")


@_query("op7_near_dup")
def op7_near_dup(spark, sf):
    """Near-duplicate components of all ``documents``: three words, similarity 0.85."""
    from . import near_dup

    return near_dup.near_duplicates(table(spark, sf, "documents"), "doc_id", "text", shingle=3, similarity=0.85)


def _op8_sql() -> str:
    from . import decontaminate

    return decontaminate.oracle_sql()


@_query("op8_decontaminate", _op8_sql())
def op8_decontaminate(spark, sf):
    """Every document of ``documents`` that overlaps an item of ``benchmark``, with the item."""
    from . import decontaminate

    return decontaminate.overlaps(table(spark, sf, "documents"), "doc_id", "text",
                                  table(spark, sf, "benchmark"), "item_id", "text").drop("_text_hash")


def sentencepiece_model(name: str = "piece_bpe_32k.model") -> bytes:
    """Content of a public SentencePiece model, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@_query("op9_segmentation")
def op9_segmentation(spark, sf):
    """Two sampled segmentations of every whole text of ``documents``, without replacement: the
    piece ids, and their hash to compare them by."""
    from . import segmentation

    out = segmentation.sample_segmentations(table(spark, sf, "documents"), "doc_id", "text", sentencepiece_model(), k=2)
    return out.select("doc_id", "rank", "n_pieces", "ids", F.xxhash64("ids").alias("ids_hash"), "log_prob",
                      "perturbed", "log_inclusion", "round_trip")


@_query("op11_suffix_dedup")
def op11_suffix_dedup(spark, sf):
    """Every whole text of ``documents`` without the bytes that 200-byte strings met elsewhere cover."""
    from . import suffix_dedup

    return suffix_dedup.remove_repeats(table(spark, sf, "documents"), "doc_id", "text")


_OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
           FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, total, v, coalesce(n, 0) AS n,
             1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
      FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (CAST(sum(n) AS HUGEINT) + 2)) // (sum(total) + 2 * any_value(v)) AS q
      FROM p GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT)
      FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 10"""


@_query("op13_source_divergence", _OP13_SQL)
def op13_source_divergence(spark, sf):
    """Divergence of the sources of each language in ``documents``, and their leading terms."""
    from . import divergence

    return divergence.audit(table(spark, sf, "documents"), "text", "lang", "source")


@_query("op12_conversation_repair")
def op12_conversation_repair(spark, sf):
    """Every conversation of ``conversations``, damaged by the contract's rule and repaired at least cost."""
    from . import repair

    return repair.repair(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
