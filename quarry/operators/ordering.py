"""Ordered work without single-task windows.

``row_index`` gives every row its 0-based position in a total order (within a
group when ``partition_cols`` is given):

1. ``repartitionByRange`` on the full sort key (which should end with a unique
   tie-break) splits the rows into ranges of similar size - a hot key value is
   split across ranges by the tie-break, so no range holds a third of the data;
2. ``sortWithinPartitions`` orders each range, and a reliable checkpoint into
   the shared checkpoint folder freezes ranges and order (recomputing a range
   partitioner can re-sample; a checkpoint survives executor loss);
3. one small job counts rows per range; the prefix sums (one number per range)
   become literals;
4. index = range offset + position inside the range.

``blocked_window`` evaluates row-frame windows (rolling mean, lag) on fixed
size blocks of the index, copying the last ``halo`` rows of each block into the
next one, so every task holds at most ``block + halo`` rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS_PER_RANGE = 2_000_000  # rows per range partition at scale
IDX = "__idx"


def _sort_cols(cols):
    out = []
    for x in cols:
        out.append(F.col(f"`{x}`") if isinstance(x, str) else x)
    return out


def join_groups(df: DataFrame, table: DataFrame, group_cols) -> DataFrame:
    """Inner join of ``df`` with a table of one row per group; a NULL group meets the NULL group."""
    other = {x: f"__g{i}" for i, x in enumerate(group_cols)}
    table = table.withColumnsRenamed(other)
    same = None
    for x, y in other.items():
        one = F.col(f"`{x}`").eqNullSafe(F.col(y))
        same = one if same is None else same & one
    return df.join(table, same).drop(*other.values())


def row_index(df: DataFrame, order_cols, partition_cols=None, out: str = IDX,
              rows_per_range: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position by ``order_cols`` (within ``partition_cols``)."""
    rows_per_range = rows_per_range or ROWS_PER_RANGE
    partition_cols = list(partition_cols or [])
    keys = _sort_cols(partition_cols) + _sort_cols(order_cols)
    n = df.count()
    if n <= rows_per_range:
        # Bounded input: one ordered window over at most ``rows_per_range`` rows.
        w = Window.partitionBy(*partition_cols).orderBy(*keys) if partition_cols \
            else Window.orderBy(*keys)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
    n_ranges = max(1, math.ceil(n / rows_per_range))
    ranged = df.repartitionByRange(n_ranges, *keys).sortWithinPartitions(*keys)
    frozen = cut_lineage(ranged)
    pid = F.spark_partition_id()
    # Position inside the range: monotonically_increasing_id is (pid << 33) + position.
    pos = F.monotonically_increasing_id() - (pid.cast("bigint") * F.lit(1 << 33))
    with_pos = frozen.withColumn("__pid", pid).withColumn("__pos", pos)
    counts = with_pos.groupBy("__pid").agg(F.count(F.lit(1)).alias("n"))
    if n_ranges <= 1000:
        offsets, run = {}, 0
        for p, k in sorted((r["__pid"], r["n"]) for r in counts.collect()):
            offsets[p] = run
            run += k
        off = F.create_map(*[x for p, o in offsets.items() for x in (F.lit(p), F.lit(o))]) \
            if offsets else F.create_map(F.lit(0), F.lit(0))
        indexed = with_pos.withColumn(out, (off[F.col("__pid")] + F.col("__pos")).cast("bigint"))
    else:
        # One row per range (n / rows_per_range rows): a bounded table, broadcast.
        before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
        offs = counts.select("__pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__off"))
        indexed = (with_pos.join(F.broadcast(offs), "__pid")
                   .withColumn(out, (F.col("__off") + F.col("__pos")).cast("bigint")).drop("__off"))
    if partition_cols:
        # Position inside the group = global position - first global position of the group.
        # The group table is aggregated map-side; AQE splits a skewed group in the join.
        from .features import sized
        starts = indexed.groupBy(*partition_cols).agg(F.min(out).alias("__start"))
        indexed = join_groups(indexed, sized(starts), partition_cols).withColumn(out, F.col(out) - F.col("__start")).drop("__start")
    return indexed.drop("__pid", "__pos")


def blocked_window(df: DataFrame, idx_col: str, halo: int, columns: dict,
                   partition_cols=None, block: int = 100_000) -> DataFrame:
    """Evaluate row-frame window columns on index blocks with a halo.

    ``columns`` maps output name -> function(Window) -> Column, where the window
    given is already partitioned by block (and ``partition_cols``) and ordered
    by ``idx_col``; frames must look back at most ``halo`` rows and never ahead.
    """
    if block < halo:
        block = halo
    partition_cols = list(partition_cols or [])
    idx = F.col(idx_col)
    blk = F.floor(idx / F.lit(block)).cast("bigint")
    own = F.struct(blk.alias("b"), F.lit(False).alias("c"))
    if halo > 0:
        # One pass: rows in the last ``halo`` places of a block also emit a copy
        # for the next block (no union, so the input is computed once).
        copy = F.struct((blk + 1).alias("b"), F.lit(True).alias("c"))
        tags = F.when((idx % F.lit(block)) >= F.lit(block - halo), F.array(own, copy)).otherwise(F.array(own))
    else:
        tags = F.array(own)
    base = (df.withColumn("__halo", F.explode(tags))
            .withColumn("__blk", F.col("__halo.b")).withColumn("__copy", F.col("__halo.c")).drop("__halo"))
    w = Window.partitionBy(*(partition_cols + ["__blk"])).orderBy(idx_col)
    for name, fn in columns.items():
        base = base.withColumn(name, fn(w))
    return base.where(~F.col("__copy")).drop("__blk", "__copy")


def rolling(w: Window, value: Column, size: int, how: str) -> Column:
    """Rolling statistic over the last ``size`` rows; NULL until the window is full."""
    frame = w.rowsBetween(-(size - 1), 0)
    full = F.count(F.lit(1)).over(frame) >= F.lit(size)
    stat = {"mean": F.avg(value), "std": F.stddev_samp(value), "sum": F.sum(value),
            "min": F.min(value), "max": F.max(value)}[how].over(frame)
    return F.when(full, stat)


MAX_BLOCKS = 100_000  # offsets table size bound (it is broadcast)


def prefix_sums(df: DataFrame, idx_col: str, value_cols, block: int = 100_000,
                suffix: str = "_cum", n: int | None = None) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ``idx_col`` order (0-based, dense).

    Block totals (one row per block of ``block`` index values) give each
    block's offset; inside a block a window partitioned by block adds the
    running part. The block size grows with n so there are never more than
    ``MAX_BLOCKS`` blocks: the offsets table that is broadcast stays bounded.
    """
    value_cols = list(value_cols)
    if n is None:
        n = df.count()
    block = max(block, -(-n // MAX_BLOCKS))
    blk = F.floor(F.col(idx_col) / F.lit(block)).cast("bigint")
    with_blk = df.withColumn("__blk", blk)
    totals = with_blk.groupBy("__blk").agg(*[F.sum(v).alias(f"__t_{v}") for v in value_cols])
    before = Window.orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    # ``totals`` has at most MAX_BLOCKS rows.
    offsets = totals.select("__blk", *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0))
                                       .alias(f"__o_{v}") for v in value_cols])
    w = (Window.partitionBy("__blk").orderBy(idx_col)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = with_blk.join(F.broadcast(offsets), "__blk", "left")
    for v in value_cols:
        out = out.withColumn(v + suffix, F.sum(v).over(w) + F.col(f"__o_{v}"))
    return out.drop("__blk", *[f"__o_{v}" for v in value_cols])
