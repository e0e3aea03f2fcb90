"""Benchmark decontamination by spaced-seed hashing (operator 8), native DataFrame functions.

A fixed mask of 1s and 0s laid over consecutive words takes the words under its 1s; two
passages that differ in words under 0s alone have the same masked words. All masked word tuples
of the benchmark items and of the documents are hashed and joined. Each hit fixes an alignment
of a document with an item; the item's words are then compared with the aligned words, and the
pair counts as an overlap if enough words agree in a window of the item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import write_stage

MASKS = ("11010011", "11101001")  # spans of 8 words, 5 of them in use
BROADCAST_SEEDS = 2_000_000       # seed rows, about 40 bytes each


def words(text):
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(tokens, mask: str, salt: int):
    """Hash of the masked words at each position that the mask fits in."""
    def at(i):
        return F.xxhash64(F.lit(salt), *[F.get(tokens, i + F.lit(j)) for j, on in enumerate(mask) if on == "1"])

    last = F.size(tokens) - F.lit(len(mask))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<bigint>"))


def _seed_rows(frame: DataFrame, keys: list[str], masks) -> DataFrame:
    """(keys, place, seed): one row per position and mask."""
    rows = None
    for salt, mask in enumerate(masks):
        part = frame.select(*keys, F.posexplode(_seeds(F.col("_words"), mask, salt)).alias("place", "seed"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def overlaps(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str,
             window: int = 20, agree: float = 0.8, masks=MASKS) -> DataFrame:
    """(id, item, matched, window, start, _text_hash): each document and item that overlap.

    They overlap if some window of ``window`` consecutive words of the item (the whole item, if
    it is shorter) has at least ``agree`` of its words at the same places of the document, under an
    alignment that a seed found; ``matched`` is the most words that agree in a window and
    ``start`` the word of the document where the item's first word would stand (least of the
    best). Items shorter than the masks' span have no seed and give no overlap; empty and null
    texts have no words. Rows with equal id and text give one result row; ``_text_hash`` tells
    rows apart that share an id, or have none. Other columns, whatever their names, are not read;
    empty tables give an empty result.

    Document seeds are never shuffled while the benchmark's seeds fit the broadcast bound; beyond
    it both sides shuffle by seed, and the adaptive join splits hot seeds.
    """
    bench = items.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("_words")).distinct()
    bench = write_stage(bench.where(F.size("_words") >= min(map(len, masks))), "items")
    seeds = write_stage(_seed_rows(bench, ["item"], masks).withColumnRenamed("place", "at"), "seeds")
    known = seeds.select("seed").distinct()
    if seeds.count() <= BROADCAST_SEEDS:
        known, seeds = F.broadcast(known), F.broadcast(seeds)
    text = F.coalesce(F.col(text_col), F.lit(""))
    mine = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("_text_hash"),
                       words(F.col(text_col)).alias("_words"))
    found = _seed_rows(mine, ["id", "_text_hash"], masks).join(known, "seed", "left_semi")
    hits = write_stage(found.join(seeds, "seed")
                       .select("id", "_text_hash", "item", (F.col("place") - F.col("at")).alias("start")).distinct(), "hits")
    named = hits.withColumnRenamed("id", "_hit_id").withColumnRenamed("_text_hash", "_hit_hash")
    pairs = (mine.withColumnRenamed("_words", "_doc").join(
        named, F.col("id").eqNullSafe(F.col("_hit_id")) & (F.col("_text_hash") == F.col("_hit_hash")))
        .join(bench, "item"))
    size = F.least(F.lit(window), F.size("_words"))
    # Running counts of agreeing words, then differences at a window's distance.
    same = F.transform(F.col("_words"), lambda w, j: F.coalesce(
        F.when(j + F.col("start") >= 0, F.get("_doc", j + F.col("start"))) == w, F.lit(False)).cast("int"))
    run = F.transform(F.sequence(F.lit(0), F.size("_words") - size),
                      lambda j: F.aggregate(F.slice("_same", j + 1, size), F.lit(0), lambda a, x: a + x))
    scored = (pairs.withColumn("_same", same).withColumn("window", size)
              .withColumn("matched", F.array_max(run)).where(F.col("matched") >= F.lit(agree) * F.col("window")))
    best = F.max(F.struct("matched", (-F.col("start")).alias("back"), "window"))
    return (scored.groupBy("id", "_text_hash", "item").agg(best.alias("best"))
            .select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best.matched").alias("matched"),
                    F.col("best.window").alias("window"), (-F.col("best.back")).alias("start"), "_text_hash"))


def clean(docs: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`overlaps` found; all its columns stay."""
    bad = write_stage(found.select(F.col(id_col).alias("_bad_id"), F.col("_text_hash").alias("_bad_hash")).distinct(),
                      "contaminated")
    here = F.col(id_col).eqNullSafe(F.col("_bad_id")) & (
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_bad_hash"))
    return docs.join(bad, here, "left_anti")


def oracle_sql(table: str = "documents", window: int = 20, agree: float = 0.8, masks=MASKS) -> str:
    """DuckDB SQL of :func:`overlaps` for ``documents`` (or a table like it) and ``benchmark``."""
    def split(x):
        return (f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')")

    def seeds(of):
        return " UNION ALL ".join(
            f"SELECT key, i AS place, [{', '.join([repr(str(s))] + [f'w[i + {j + 1}]' for j, on in enumerate(m) if on == '1'])}] AS seed "
            f"FROM (SELECT key, w, unnest(range(0, len(w) - {len(m) - 1})) AS i FROM {of})" for s, m in enumerate(masks))

    return f"""
WITH d AS (SELECT doc_id AS key, {split('text')} AS w FROM {table}),
b AS (SELECT DISTINCT item_id AS key, {split('text')} AS w FROM benchmark),
ds AS ({seeds('d')}), bs AS ({seeds('b')}),
h AS (SELECT DISTINCT ds.key AS doc_id, bs.key AS item_id, ds.place - bs.place AS start FROM ds JOIN bs USING (seed)),
p AS (SELECT h.*, b.w, least({window}, len(b.w)) AS size,
             list_transform(range(0, len(b.w)), lambda j: CASE WHEN j + h.start >= 0 AND d.w[j + h.start + 1] = b.w[j + 1]
                                                               THEN 1 ELSE 0 END) AS same
      FROM h JOIN d ON d.key = h.doc_id JOIN b ON b.key = h.item_id),
m AS (SELECT doc_id, item_id, start, size, list_max(list_transform(range(0, len(w) - size + 1),
             lambda j: list_sum(same[j + 1:j + size]))) AS matched FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) AS k
      FROM m WHERE matched >= {agree} * size)
SELECT doc_id, item_id, CAST(matched AS INTEGER) AS matched, CAST(size AS INTEGER) AS "window",
       CAST(start AS INTEGER) AS start FROM r WHERE k = 1"""
