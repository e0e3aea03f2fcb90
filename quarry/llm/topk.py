"""Exact top-k inner-product search with block-at-a-time pruning (operator 5).

A vector's components are its term weights. Rows are dealt into blocks of consecutive
rows of a locality order, and each block keeps, per term, the largest and the smallest
weight, and its rows as a forward index (a matrix). For a query, the sum over terms of
query weight times the block's extreme in that direction bounds every score in the block.
Blocks are visited by falling bound and scored whole through the forward index, until the
next bound is below the k-th best score so far; equal bounds are still scored, since a tie
goes to the smaller id.

Queries and blocks meet in tasks of bounded size (``queries_per_task`` queries by
``blocks_per_task`` blocks); each gives its k best per query, and these are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_INDEX = "dim int, _group long, ids array<bigint>, high array<bigint>, low array<bigint>, rows binary"
_EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(id, dim, v): components floor(scale * x), x as double. Rows whose id or vector is null,
    or whose vector is empty or holds a null or non-finite component, are left out."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
            .select(F.col(id_col).cast("bigint").alias("id"), F.size(x).alias("dim"),
                    F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("bigint")).alias("v")))


def build_blocks(vectors: DataFrame, block_rows: int = 256, blocks_per_task: int = 128) -> DataFrame:
    """The index: one row per block. Rows are range-partitioned by (dim, strongest term, its
    sign, second strongest, id), so that rows of a block lean the same way and its bounds are
    tight; the id splits any number of equal vectors over ranges and blocks."""
    strongest = F.array_sort(F.transform(F.col("v"), lambda c, i: F.struct(
        (-F.abs(c)).alias("size"), i.alias("term"), F.signum(c).alias("sign"))))
    keyed = (vectors.withColumn("_s", F.get(strongest, F.lit(0))).withColumn("_t", F.get(strongest, F.lit(1)))
             .select("id", "dim", "v", F.col("_s.term").alias("_k0"), F.col("_s.sign").alias("_k1"),
                     F.col("_t.term").alias("_k2"), F.col("_t.sign").alias("_k3")))
    order = ["dim", "_k0", "_k1", "_k2", "_k3", "id"]
    placed = (keyed.repartitionByRange(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
              .sortWithinPartitions(*order).select("id", "dim", "v", F.spark_partition_id().alias("part")))

    def blocks(batches):
        import numpy as np
        import pyarrow as pa

        held: list = []  # rows of the block being filled
        made = 0

        def close():
            nonlocal made
            ids, dim, part = [h[0] for h in held], held[0][1], held[0][3]
            m = np.array([h[2] for h in held], dtype=np.int64)
            group = (part << 32) + made // blocks_per_task
            made += 1
            out = {"dim": [dim], "_group": [group], "ids": [ids], "high": [m.max(0).tolist()],
                   "low": [m.min(0).tolist()], "rows": [m.tobytes()]}
            held.clear()
            return pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("dim", pa.int32()), ("_group", pa.int64()), ("ids", pa.list_(pa.int64())),
                 ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("rows", pa.binary())]))

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (held[0][1] != row[1] or len(held) == block_rows):
                    yield close()
                held.append(row)
        if held:
            yield close()

    return placed.mapInArrow(blocks, _INDEX)


def visit(q_ids, q, index: list[tuple], k: int):
    """Top-k of each query among the blocks ``(ids, high, low, rows)``: the pruned visit.

    Returns lists (query_id, id, score) and the number of blocks scored."""
    import numpy as np

    highs, lows = np.stack([b[1] for b in index]), np.stack([b[2] for b in index])
    size = float(np.abs(q).max(initial=0)) * float(max(np.abs(highs).max(), np.abs(lows).max())) * q.shape[1]
    # Sums below 2^53 are exact in doubles, whose matrix product is fast; larger ones use Python's integers.
    kind = np.float64 if size < _EXACT else object
    highs, lows, qk = highs.astype(kind), lows.astype(kind), q.astype(kind)
    up, down = np.where(qk > 0, qk, 0), np.where(qk < 0, qk, 0)
    bounds = up @ highs.T + down @ lows.T
    rows = [b[3].astype(kind) for b in index]
    out, scored = [], 0
    for i in range(len(q)):
        order = np.argsort(-bounds[i], kind="stable")
        best_s, best_id = np.empty(0, dtype=kind), np.empty(0, dtype=np.int64)
        for b in order:
            if len(best_s) == k and bounds[i][b] < best_s[-1]:
                break
            s, ids = rows[b] @ qk[i], index[b][0]
            scored += 1
            other = ids != q_ids[i]
            s, ids = np.concatenate([best_s, s[other]]), np.concatenate([best_id, ids[other]])
            if len(s) > 4 * k and kind is np.float64:  # all that tie with the k-th stay
                keep = s >= -np.partition(-s, k - 1)[k - 1]
                s, ids = s[keep], ids[keep]
            top = np.lexsort((ids, -s))[:k]
            best_s, best_id = s[top], ids[top]
        out += [(int(q_ids[i]), int(x), int(y)) for x, y in zip(best_id, best_s, strict=True)]
    return out, scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 256,
          blocks_per_task: int = 128, queries_per_task: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with the
    rows of other ids, ties to the smaller id; all rows where there are fewer than k. Equal query
    rows count once; different vectors under one query id are ranked together.

    Both inputs are :func:`quantised` frames. Vectors of different lengths have no product, so
    they never meet. Repeated rows are candidates of their own; a row that shares the query's id
    is not one. Empty inputs give an empty result. No candidate is dropped but by its bound.
    """
    from ._common import write_stage

    index = write_stage(build_blocks(vectors, block_rows, blocks_per_task), "blocks")
    tasks = index.select("dim", "_group").distinct()
    chunk = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    queries = queries.dropDuplicates(["id", "v"])
    n = queries.count()
    chunks = max(1, -(-n // queries_per_task))
    asked = queries.select("dim", F.pmod(chunk, F.lit(chunks)).alias("_chunk"), F.col("id"), F.col("v"))
    blocks_by = index.join(asked.select("dim", "_chunk").distinct(), "dim")
    asked_by = asked.join(tasks, "dim").select(
        F.col("dim").alias("q_dim"), F.col("_group").alias("q_group"), F.col("_chunk").alias("q_chunk"), "id", "v")

    def search(key, left, right):
        import numpy as np
        import pandas as pd

        dim = int(key[0])
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        found = [(np.asarray(i, dtype=np.int64), np.asarray(h, dtype=np.int64), np.asarray(w, dtype=np.int64),
                  np.frombuffer(r, dtype=np.int64).reshape(-1, dim))
                 for i, h, w, r in zip(left["ids"], left["high"], left["low"], left["rows"], strict=True)]
        q = np.array(right["v"].tolist(), dtype=np.int64).reshape(-1, dim)
        rows, _ = visit(right["id"].to_numpy(), q, found, k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = (blocks_by.groupBy("dim", "_group", "_chunk").cogroup(asked_by.groupBy("q_dim", "q_group", "q_chunk"))
             .applyInPandas(search, "query_id bigint, vec_id bigint, score bigint"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
