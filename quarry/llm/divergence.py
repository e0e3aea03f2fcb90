"""Term statistics of sources against each other by a minimal-perfect-hash recount (operator 13).

1. *Frequency filter.* Tasks count, for each term of a language, the documents that hold it, and
   hand on bounded tables of partial counts; terms in fewer than ``min_docs`` documents go.
2. *Perfect hashes.* The terms kept of a language are dealt by hash into shards of about 4,096. A
   shard gets a minimal perfect hash (hash, then displace): each term has a slot of its own, and
   the shard holds its terms in slot order. Slots are numbered through the shards of a language.
3. *Recount.* Shards are broadcast in rounds of at most ``round_bytes`` (measured), each round with
   one pass over the texts, so that what is broadcast has a bound whatever the vocabulary. Each
   task counts the terms of a batch, finds their slots, keeps those whose stored term is equal,
   and increments dense blocks of slots per group, handed on when ``held`` blocks are full.
4. *Divergence.* Slots are compared in blocks with all groups of the language, in whole numbers:
   ``p = 1 + floor(scale * (count + 2) / (N + 2 V))``, ``f = floor((p - q)^2 / (p + q))``.

Terms are runs of letters A-Z, a-z and of characters beyond ASCII; only A-Z are lower-cased. Null
texts, languages and sources count as ''. Repeated rows count as documents of their own; ids are
not read. Groups without terms have N = 0 and take part. Ties rank by the item's UTF-8 bytes. An
empty table gives no rows. Other columns, whatever their names, are not read. A block of slots
holds about 4 million counts at most, whatever the number of sources.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import worker_state, write_stage

SHARD = 4096  # terms of a shard, about; slots of a dense block
ENTRIES = 1 << 18  # terms a task counts before it hands its table on
_SEPARATORS = [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(32 if b in set(_SEPARATORS) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(n).cast(pa.binary()).to_pylist() for n in names]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of a bounded stretch of the task that hold the term."""
    tables: dict[bytes, Counter] = {}

    def flush():
        for lang, table in tables.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(table), pa.binary()), pa.array(list(table), pa.binary()),
                 pa.array(list(table.values()), pa.int64())], names=["lang", "term", "n"])
        tables.clear()

    for batch in batches:
        for lang, text in zip(*_columns(batch, "lang", "text")):
            tables.setdefault(lang, Counter()).update(set(_terms(text)))
            if len(tables[lang]) > ENTRIES or len(tables) > 1024:
                yield from flush()
    yield from flush()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _hashes(terms, seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), np.uint64, len(terms))


def _displaced(h: np.ndarray, d, m) -> np.ndarray:
    return (_mix(h + np.uint64(0x9E3779B97F4A7C15) * np.asarray(d).astype(np.uint64)) % np.asarray(m).astype(np.uint64)).astype(np.int64)


def build_hash(terms: list[bytes]) -> tuple[int, np.ndarray, list[bytes]]:
    """(seed, displacements, terms in slot order) of a minimal perfect hash of distinct terms.

    Buckets of terms, the fullest first, take the first displacement that sends all their terms
    to free slots; buckets of one term name their slot outright, as ``-1 - slot``."""
    m, r = len(terms), len(terms) // 4 + 1
    seed = 0
    while len(np.unique(h := _hashes(terms, seed))) < m:  # equal hashes need another seed
        seed += 1
    bucket = (_mix(h) % np.uint64(r)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(r + 1))
    disp, taken, slot = np.zeros(r, np.int64), np.zeros(m, bool), np.zeros(m, np.int64)
    for b in np.argsort(-np.diff(edges), kind="stable"):
        members = order[edges[b]:edges[b + 1]]
        if len(members) < 2:
            break
        d = 0
        while True:
            at = _displaced(h[members][:, None], np.arange(d, d + 16)[None, :], m)
            ok = ~taken[at].any(0) & (np.diff(np.sort(at, 0), axis=0) > 0).all(0)
            if ok.any():
                d += int(np.argmax(ok))
                break
            d += 16
        disp[b], slot[members] = d, _displaced(h[members], d, m)
        taken[slot[members]] = True
    alone = order[edges[:-1][np.diff(edges) == 1]]
    slot[alone] = np.flatnonzero(~taken)
    disp[bucket[alone]] = -1 - slot[alone]
    return seed, disp, [terms[i] for i in np.argsort(slot)]


def _shards(kept: DataFrame) -> DataFrame:
    """(lang, shards, shard, size, seed, disp, terms): one row per shard."""
    counts = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    rows = kept.select("lang", "term").join(counts, "lang").withColumn("shards", F.ceil(F.col("v") / SHARD).cast("bigint"))

    def numbered(batches):
        for batch in batches:
            n = batch.column("shards").to_numpy(zero_copy_only=False).astype(np.uint64)
            shard = (_hashes(batch.column("term").to_pylist()) % n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("term"), batch.column("shards"),
                                              pa.array(shard)], names=["lang", "term", "shards", "shard"])

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seed, disp, terms = build_hash([bytes(t) for t in sorted(pdf["term"])])
        return pd.DataFrame({"lang": [key[0]], "shards": [key[1]], "shard": [key[2]], "size": [len(terms)], "seed": [seed],
                             "disp": [disp.tobytes()], "terms": [b"\n".join(terms)]})  # no term holds a newline

    return rows.select("lang", "term", "shards").mapInArrow(
        numbered, "lang binary, term binary, shards bigint, shard bigint").groupBy("lang", "shards", "shard").applyInPandas(
        build, "lang binary, shards bigint, shard bigint, size bigint, seed bigint, disp binary, terms binary")


class _Lookup:
    """Slots of one language's terms in the shards at hand."""

    def __init__(self, rows):
        n = rows[0]["shards"]
        self.n, self.here = np.uint64(n), np.zeros(n, bool)
        self.size, self.buckets = np.ones(n, np.int64), np.ones(n, np.int64)
        self.first, self.at, self.disp_at, self.seed = (np.zeros(n, np.int64) for _ in range(4))
        disp, terms = [], []
        for r in rows:
            s, d = r["shard"], np.frombuffer(r["disp"], np.int64)
            self.here[s], self.size[s], self.buckets[s], self.seed[s] = True, r["size"], len(d), r["seed"]
            self.first[s], self.at[s], self.disp_at[s] = r["first"], len(terms), sum(map(len, disp))
            disp.append(d)
            terms.extend(bytes(r["terms"]).split(b"\n"))
        self.disp, self.terms = np.concatenate(disp), pa.array(terms, pa.binary())

    def slots(self, terms: list[bytes]) -> np.ndarray:
        """Slot of each term, -1 where it is not the term stored there."""
        h = _hashes(terms)
        s = (h % self.n).astype(np.int64)
        for i in np.flatnonzero(self.seed[s]):
            h[i] = xxhash.xxh3_64_intdigest(terms[i], int(self.seed[s[i]]))
        d = self.disp[self.disp_at[s] + (_mix(h) % self.buckets[s].astype(np.uint64)).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, _displaced(h, np.maximum(d, 0), self.size[s]))
        stored = self.terms.take(pa.array(np.where(self.here[s], self.at[s] + slot, 0)))
        same = pc.equal(stored, pa.array(terms, pa.binary())).to_numpy(zero_copy_only=False) & self.here[s]
        return np.where(same, self.first[s] + slot, -1)


def _recount(shared, name: str, held: int):
    """(lang, source, slot, n) of the broadcast shards, from dense blocks of slots per group."""
    def run(batches):
        def build():
            by_lang: dict[bytes, list] = {}
            for r in shared.value:
                by_lang.setdefault(bytes(r["lang"]), []).append(r)
            return {lang: _Lookup(rows) for lang, rows in by_lang.items()}

        lookups = worker_state("divergence", "lookup", name, build)
        blocks: dict[tuple, np.ndarray] = {}

        def flush():
            for (lang, source, block), counts in blocks.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.binary()), pa.array([source] * len(at), pa.binary()),
                     pa.array(at + block * SHARD), pa.array(counts[at])], names=["lang", "source", "slot", "n"])
            blocks.clear()

        for batch in batches:
            groups: dict[tuple, list] = {}
            for lang, source, text in zip(*_columns(batch, "lang", "source", "text")):
                groups.setdefault((lang, source), []).append(text)
            for (lang, source), texts in groups.items():
                if lang not in lookups:
                    continue
                terms = Counter(_terms(b" ".join(texts)))
                if not terms:
                    continue
                slot = lookups[lang].slots(list(terms))
                n = np.fromiter(terms.values(), np.int64, len(terms))[slot >= 0]
                slot = slot[slot >= 0]
                by = np.argsort(slot // SHARD, kind="stable")
                slot, n = slot[by], n[by]
                cuts = np.flatnonzero(np.diff(slot // SHARD)) + 1
                for at, add in zip(np.split(slot, cuts), np.split(n, cuts)):
                    if len(at):
                        key = (lang, source, int(at[0] // SHARD))
                        if key not in blocks:
                            blocks[key] = np.zeros(SHARD, np.int64)
                        blocks[key][at % SHARD] += add  # terms of a batch are distinct, so are their slots
                if len(blocks) > held:
                    yield from flush()
        yield from flush()
    return run


def share(count: np.ndarray, total, scale: int = 1_000_000_000) -> np.ndarray:
    """``1 + floor(scale * count / total)`` in 64 bits, for counts up to 2e14 (in two digits)."""
    total = np.asarray(total, np.int64)
    q, r = np.divmod(count * 31250, total)
    return 1 + q * (scale // 31250) + r * (scale // 31250) // total


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compare(block_size: int, ranks: int):
    """Pairs of sources (sums) and leading terms of each source, over one block of slots."""
    def run(key: tuple, counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        lang, block = key
        groups = groups.sort_values("source")
        names = [bytes(x) for x in groups["source"]]
        row = {x: i for i, x in enumerate(names)}
        n, v = groups["total"].to_numpy(np.int64), int(groups["v"].iloc[0])
        width = min(block_size, v - block * block_size)
        dense = np.zeros((len(names), width), np.int64)
        dense[[row[bytes(x)] for x in counts["source"]], counts["slot"].to_numpy(np.int64) - block * block_size] = counts["n"]
        p = share(dense + 2, (n + 2 * v)[:, None])
        q = share(dense.sum(0) + 2, n.sum() + 2 * v)
        out = []
        for i in range(len(names)):
            value = apart(p[i], p[i + 1:]).sum(1)
            for j, x in enumerate(value.tolist(), i + 1):
                out += [(lang, names[i], names[j], -1, x), (lang, names[j], names[i], -1, x)]
            at = np.flatnonzero((dense[i] > 0) & (p[i] > q))
            f = apart(p[i][at], q[at])
            if len(at) > ranks:  # ties with the last rank stay: their terms decide
                stay = f >= np.partition(f, -ranks)[-ranks]
                at, f = at[stay], f[stay]
            out += [(lang, names[i], None, int(s) + block * block_size, x) for s, x in zip(at, f.tolist())]
        return pd.DataFrame(out, columns=["lang", "source", "item", "slot", "value"])
    return run


def audit(docs: DataFrame, text_col: str, lang_col: str, source_col: str, min_docs: int = 10, ranks: int = 10,
          round_bytes: int = 64 << 20, held: int = 2048) -> DataFrame:
    """(lang, source, part, item, value, rank); see the module text.

    Part ``pair``: the other sources of the language by summed divergence. Part ``term``: the
    ``ranks`` terms that the source uses more than its language does."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(n)
                         for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    spark = docs.sparkSession
    found = rows.select("lang", "text").mapInArrow(_document_counts, "lang binary, term binary, n bigint")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("docs")).where(F.col("docs") >= min_docs)
    shards = write_stage(_shards(write_stage(kept, "divergence-terms")), "divergence-shards")
    size = F.length("terms") + F.length("disp")
    order = Window.orderBy("lang", "shard")  # one row per 4,096 terms
    plan = write_stage(shards.select("lang", "shard", "size", size.alias("bytes")).select(
        "lang", "shard", "size", (F.sum("size").over(Window.partitionBy("lang").orderBy("shard")) - F.col("size")).alias("first"),
        F.floor((F.sum("bytes").over(order) - 1) / round_bytes).alias("round")), "divergence-plan")
    placed = shards.join(plan.select("lang", "shard", "first", "round"), ["lang", "shard"])
    slots = "lang binary, source binary, slot bigint, n bigint"
    counts = spark.createDataFrame([], slots)
    for r in range(1 + (plan.agg(F.max("round")).first()[0] or 0)):
        at_hand = placed.where(F.col("round") == r).select("lang", "shards", "shard", "size", "seed", "disp", "terms", "first").collect()
        if at_hand:
            shared = spark.sparkContext.broadcast([x.asDict() for x in at_hand])
            part = rows.mapInArrow(_recount(shared, uuid.uuid4().hex, held), slots)
            part = write_stage(part.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")), "divergence-counts")
            shared.destroy()
            counts = counts.unionByName(part)
    vocabulary = plan.groupBy("lang").agg(F.sum("size").alias("v"))
    groups = rows.select("lang", "source").distinct().join(
        counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = write_stage(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
                                       F.coalesce("v", F.lit(0)).alias("v")), "divergence-groups")
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    width = max(1, min(1024, (1 << 22) // widest))
    every = groups.where("v > 0").withColumn("block", F.explode(F.expr(f"sequence(0L, (v - 1) div {width})")))
    blocks = counts.withColumn("block", F.expr(f"slot div {width}"))
    parts = blocks.groupBy("lang", "block").cogroup(every.groupBy("lang", "block")).applyInPandas(
        _compare(width, ranks), "lang binary, source binary, item binary, slot bigint, value bigint")
    parts = write_stage(parts, "divergence-parts")
    bare = groups.where("v = 0").select("lang", "source")
    pairs = parts.where("slot < 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(
        bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source != item").withColumn("value", F.lit(0).cast("bigint")))
    stored = placed.select("lang", "first", F.posexplode(F.split(F.col("terms").cast("string"), "\n"))).select(
        "lang", (F.col("first") + F.col("pos")).alias("slot"), F.col("col").cast("binary").alias("item"))
    terms = parts.where("slot >= 0").select("lang", "source", "slot", "value").join(stored, ["lang", "slot"]).drop("slot")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(best)).unionByName(
        terms.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks))
    return ranked.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source")], "part",
                         F.col("item").cast("string").alias("item"), "value", "rank")
