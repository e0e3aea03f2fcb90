"""Tabular profiling: missing values, duplicates, distinct counts, describe,
correlations, top values, IQR outliers, target profile, histograms and
missingness patterns.

Design (SURVEY D1): never one job per column. Numeric statistics come from one
wide aggregation; distinct / top values / mode come from one long
``(column, value) -> count`` frame. Results are small frames; only fitted
parameters bounded by the number of columns are ever brought to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (c, categorical_columns, numeric_columns, type_class,
                                 value_comparable)
from ..sources.scan import normalise_missing
from .quantiles import bracket_quantiles, quantiles


def _schema_kinds(df: DataFrame) -> dict:
    return {f.name: type_class(f.dataType) for f in df.schema.fields}


def _explode_rows(row_df: DataFrame, structs: list) -> DataFrame:
    """One-row frame -> one row per struct (lazy reshaping of a wide aggregate)."""
    return row_df.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


# ---------------------------------------------------------------- missing values
def missing_counts(df: DataFrame) -> DataFrame:
    """(column, ordinal, n_rows, n_missing, missing_pct, total_missing, cell_missing_pct)
    for every column from one aggregation job (A2, A3)."""
    df = normalise_missing(df)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, name in enumerate(df.columns):
        aggs.append(F.count_if(c(name).isNull()).alias(f"m{i}"))
    ncols = len(df.columns)
    wide = df.agg(*aggs)
    total = sum((F.col(f"m{i}") for i in range(ncols)), F.lit(0))
    wide = wide.withColumn("__total", total.cast("bigint"))
    structs = [F.struct(F.lit(name).alias("column"), F.lit(i).alias("ordinal"),
                        F.col("__n").alias("n_rows"), F.col(f"m{i}").alias("n_missing"),
                        F.col("__total").alias("total_missing"))
               for i, name in enumerate(df.columns)]
    out = _explode_rows(wide, structs)
    return (out.withColumn("missing_pct", F.try_divide(F.col("n_missing") * 100.0, F.col("n_rows")))
            .withColumn("cell_missing_pct",
                        F.try_divide(F.col("total_missing") * 100.0, F.col("n_rows") * F.lit(ncols))))


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing > 0 plus table totals."""
    return (missing_counts(df).where(F.col("n_missing") > 0)
            .select("column", "n_missing", "missing_pct", "total_missing", "cell_missing_pct"))


# ---------------------------------------------------------------- duplicates
def _groupable(df: DataFrame) -> list:
    cols = [c(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    cols += [F.to_json(c(f.name)).alias(f.name) for f in df.schema.fields
             if isinstance(f.dataType, T.MapType)]
    return cols


def _dup_summary(groups: DataFrame) -> DataFrame:
    return (groups.agg(F.coalesce(F.sum("__k"), F.lit(0)).cast("bigint").alias("n_rows"),
                       F.coalesce(F.sum(F.col("__k") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))
            .withColumn("duplicate_pct", F.try_divide(F.col("n_duplicates") * 100.0, F.col("n_rows"))))


def duplicate_counts(df: DataFrame, method: str = "hash") -> DataFrame:
    """Rows beyond the first of each identical group (A4), NULLs compare equal. Exact.

    ``direct``: group by all columns (every full row is shuffled once, map-side
    partial counts collapse a hot duplicate group first).
    ``hash`` (default): group by two independent row hashes (96 bits) - a few
    bytes per row cross the shuffle. Rows with a unique hash are unique rows;
    only rows whose hash repeats are grouped exactly by all columns (semi-join
    on the repeated hashes, broadcast only under the size check), so hash
    collisions cannot change the result.
    """
    df = normalise_missing(df)
    cols = _groupable(df)
    if method == "direct":
        return _dup_summary(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__k")))
    hashed = df.select(*cols).withColumn("__h1", F.xxhash64(*cols)).withColumn("__h2", F.hash(*cols))
    by_hash = hashed.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__k"))
    totals = by_hash.agg(F.coalesce(F.sum("__k"), F.lit(0)).cast("bigint").alias("n"),
                         F.count_if(F.col("__k") > 1).alias("n_rep")).first()
    n, n_rep = totals["n"], totals["n_rep"]
    spark = df.sparkSession
    if not n_rep:
        dups = 0
    else:
        from ..session import cut_lineage
        from .features import sized
        repeated = cut_lineage(by_hash.where(F.col("__k") > 1).select("__h1", "__h2"))
        cand = hashed.join(sized(repeated), ["__h1", "__h2"], "left_semi").drop("__h1", "__h2")
        exact = cand.groupBy(*cand.columns).agg(F.count(F.lit(1)).alias("__k"))
        dups = exact.agg(F.coalesce(F.sum(F.col("__k") - 1), F.lit(0))).first()[0]
    return spark.createDataFrame([(n, dups, (dups * 100.0 / n) if n else None)],
                                 "n_rows bigint, n_duplicates bigint, duplicate_pct double")


# ---------------------------------------------------------------- value counts
def value_counts(df: DataFrame, cols=None) -> DataFrame:
    """Long frame (column, value, count) over the chosen columns; NULL values kept.

    Values are compared as strings; nested columns are skipped.
    """
    df = normalise_missing(df)
    cols = list(cols) if cols is not None else df.columns
    exprs = []
    for name in cols:
        v = value_comparable(df, name)
        if v is not None:
            exprs.append(F.struct(F.lit(name).alias("column"), v.alias("value")))
    if not exprs:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint")
    long = df.select(F.explode(F.array(*exprs)).alias("kv")).select("kv.column", "kv.value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


HASH_MIN_LENGTH = 32  # strings longer than this travel as hashes in distinct counting


def column_counts(df: DataFrame, cols=None) -> DataFrame:
    """(column, n_rows, n_missing, n_distinct) per column, exact, one shuffle of short keys.

    Short values (numbers, dates, strings up to ``HASH_MIN_LENGTH`` characters)
    are grouped by value. Long strings travel as two independent hashes (96
    bits) instead, so long unique texts never cross a shuffle. Only when a hash
    of a long value repeats (copies, or a collision) are those rows' values
    grouped exactly (semi-join on the repeated hashes, broadcast only under the
    size check); each such hash adds its distinct values minus one.
    """
    df = normalise_missing(df)
    cols = [x for x in (list(cols) if cols is not None else df.columns) if value_comparable(df, x) is not None]
    spark = df.sparkSession
    schema = "column string, n_rows bigint, n_missing bigint, n_distinct bigint"
    if not cols:
        return spark.createDataFrame([], schema)
    exprs = []
    for x in cols:
        v = value_comparable(df, x)
        if type_class(df.schema[x].dataType) == "categorical":
            long_v = F.length(v) > F.lit(HASH_MIN_LENGTH)
        else:
            long_v = F.lit(False)
        exprs.append(F.struct(F.lit(x).alias("column"), v.alias("value"),
                              F.when(~long_v | v.isNull(), v).alias("key"),
                              F.when(long_v, F.xxhash64(v)).alias("h1"),
                              F.when(long_v, F.hash(v)).alias("h2")))
    long = df.select(F.explode(F.array(*exprs)).alias("kv")).select("kv.*")
    g = (long.groupBy("column", "key", "h1", "h2", F.col("value").isNull().alias("is_null"))
         .agg(F.count(F.lit(1)).alias("k")))
    per_col = {r["column"]: r for r in g.groupBy("column").agg(
        F.sum("k").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("is_null"), F.col("k"))), F.lit(0)).alias("n_missing"),
        F.count_if(~F.col("is_null")).alias("n_groups"),
        F.count_if(F.col("h1").isNotNull() & (F.col("k") > 1)).alias("n_repeated")).collect()}
    extra = {}
    if any(r["n_repeated"] for r in per_col.values()):
        from ..session import cut_lineage
        from .features import sized
        repeated = cut_lineage(g.where(F.col("h1").isNotNull() & (F.col("k") > 1)).select("column", "h1", "h2"))
        cand = long.where(F.col("h1").isNotNull()).join(sized(repeated), ["column", "h1", "h2"], "left_semi")
        verified = (cand.groupBy("column", "h1", "h2", "value").agg(F.count(F.lit(1)).alias("_c"))
                    .groupBy("column", "h1", "h2").agg(F.count(F.lit(1)).alias("dv"))
                    .groupBy("column").agg(F.sum(F.col("dv") - 1).alias("extra")))
        extra = {r["column"]: r["extra"] for r in verified.collect()}
    rows = [(x, per_col[x]["n_rows"], per_col[x]["n_missing"], per_col[x]["n_groups"] + (extra.get(x) or 0))
            for x in cols if x in per_col]
    return spark.createDataFrame(rows, schema)


def _long_values(df: DataFrame, col: str):
    v = value_comparable(df, col)
    return df.select(v.alias("value")).where(F.length("value") > F.lit(HASH_MIN_LENGTH)) \
        .withColumn("h1", F.xxhash64("value")).withColumn("h2", F.hash("value"))


def top_values_hashed(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """Exact top ``k`` (value, count) of one string column, count desc then value
    asc, without shuffling long values.

    Counts come from hash groups (long strings) and value groups (short ones),
    as in :func:`column_counts`. The k-th largest count c splits the answer:
    groups counted above c are in it, and the remaining places go to the
    smallest values among groups counted exactly c. Long values are only read
    back for those groups, through an ordered top-N (each task keeps N rows): at
    most ``k`` values reach the driver. Their counts are then checked by value, so
    a hash collision cannot change the result.
    """
    from ..session import cut_lineage
    from .features import sized
    df = normalise_missing(df)
    spark = df.sparkSession
    v = value_comparable(df, col)
    long_v = F.length(v) > F.lit(HASH_MIN_LENGTH)
    g = cut_lineage(df.where(v.isNotNull()).select(
        F.when(~long_v, v).alias("key"), F.when(long_v, F.xxhash64(v)).alias("h1"),
        F.when(long_v, F.hash(v)).alias("h2")).groupBy("key", "h1", "h2").agg(F.count(F.lit(1)).alias("cnt")))
    top = g.orderBy(F.col("cnt").desc()).limit(k).collect()
    if not top:
        return spark.createDataFrame([], "value string, count bigint")
    c = min(r["cnt"] for r in top) if len(top) == k else 0
    above = g.where(F.col("cnt") > c).collect()          # fewer than k groups
    need = k - len(above)
    rows = []
    long_hashes = [(r["h1"], r["h2"], r["cnt"]) for r in above if r["key"] is None]
    rows += [(r["key"], r["cnt"]) for r in above if r["key"] is not None]
    if long_hashes:
        hs = spark.createDataFrame([(a, b) for a, b, _ in long_hashes], "h1 long, h2 int")
        vals = (_long_values(df, col).join(F.broadcast(hs), ["h1", "h2"], "left_semi")
                .groupBy("h1", "h2").agg(F.min("value").alias("value")).collect())
        cnt = {(a, b): n for a, b, n in long_hashes}
        rows += [(r["value"], cnt[(r["h1"], r["h2"])]) for r in vals]
    if need > 0 and c > 0:
        # Smallest short values counted exactly c.
        rows += [(r["key"], r["cnt"]) for r in
                 g.where((F.col("cnt") == c) & F.col("key").isNotNull()).orderBy("key").limit(need).collect()]
        # Smallest long values counted exactly c: an ordered top-N of the values of those hashes, one per hash.
        tied = sized(g.where((F.col("cnt") == c) & F.col("key").isNull()).select("h1", "h2"))
        held = _long_values(df, col).join(tied, ["h1", "h2"], "left_semi")
        if c > 1:
            held = held.groupBy("h1", "h2").agg(F.min("value").alias("value"))
        rows += [(r["value"], c) for r in held.select("value").orderBy("value").limit(need).collect()]
    rows.sort(key=lambda r: (-r[1], r[0]))
    rows = rows[:k]
    # A hash shared by two long values would show as a count too high: recount the chosen ones by value.
    chosen = spark.createDataFrame(rows, "value string, expected bigint")
    seen = {r["value"]: r["n"] for r in df.select(v.alias("value")).join(F.broadcast(chosen), "value")
            .groupBy("value").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(seen.get(value) != n for value, n in rows):
        exact = top_values(df, [col], k).select("value", "count")
        return exact
    return spark.createDataFrame(rows, "value string, count bigint")


def distinct_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, n_rows, n_distinct, is_constant, is_high_cardinality, is_potential_id).

    Exact by default from the long value-count frame; ``approx=True`` uses one
    wide ``approx_count_distinct`` aggregate instead (no shuffle of values).
    """
    df = normalise_missing(df)
    kinds = _schema_kinds(df)
    names = [f.name for f in df.schema.fields if value_comparable(df, f.name) is not None]
    if approx:
        wide = df.agg(F.count(F.lit(1)).alias("__n"),
                      *[F.approx_count_distinct(c(n)).alias(f"d{i}") for i, n in enumerate(names)])
        prof = _explode_rows(wide, [F.struct(F.lit(n).alias("column"), F.lit(i).alias("ordinal"),
                                             F.col("__n").alias("n_rows"),
                                             F.col(f"d{i}").cast("bigint").alias("n_distinct"))
                                    for i, n in enumerate(names)])
    else:
        ordinal = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
        prof = (column_counts(df, names)
                .withColumn("ordinal", ordinal[F.col("column")])
                .select("column", "ordinal", "n_rows", "n_distinct"))
    kind_map = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(kinds[n]))]) if names \
        else F.lit(None)
    return (prof
            .withColumn("type_class", kind_map[F.col("column")])
            .withColumn("is_constant", F.col("n_distinct") <= 1)
            .withColumn("is_high_cardinality",
                        (F.col("type_class") == "categorical") & (F.col("n_distinct") > F.col("n_rows") * 0.5))
            .withColumn("is_potential_id", F.col("n_distinct") == F.col("n_rows")))


# ---------------------------------------------------------------- describe
def describe(df: DataFrame, cols=None, approx: bool = False, quantile_method: str = "brackets") -> DataFrame:
    """count, mean, std (n-1), min, 25/50/75 % (linear), max per numeric column.

    The moments come from the first scan of :func:`quantiles.bracket_quantiles`, which gives the
    quartiles of all columns (exact at any size; ``approx=True`` uses ``percentile_approx``). Only a few numbers per column reach the driver.
    """
    df = normalise_missing(df)
    cols = list(cols) if cols is not None else numeric_columns(df)
    schema = ("column string, ordinal int, count bigint, mean double, std double, min double, "
              "q25 double, q50 double, q75 double, max double")
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], schema)
    probs, moments = [0.25, 0.5, 0.75], {}
    if approx or quantile_method != "brackets":
        qs = quantiles(df, cols, probs, "approx" if approx else quantile_method)
        aggs = []
        for i, name in enumerate(cols):
            x = c(name).cast("double")
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                     F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        m = df.agg(*aggs).first()
        moments = {x: tuple(m[f"{k}{i}"] for k in ("n", "mean", "std", "lo", "hi")) for i, x in enumerate(cols)}
    else:
        qs = bracket_quantiles(df, cols, probs, moments=moments)
    rows = [(name, i, *moments[name][:4], *qs[name], moments[name][4]) for i, name in enumerate(cols)]
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- correlations
def correlations(df: DataFrame, cols=None) -> DataFrame:
    """Pearson r of every numeric pair on pairwise-complete rows (A10, D7), for any number of columns.

    One cheap pass gives each column's mean, which is taken off before anything is
    squared. In the second, each task adds up, over Arrow batches, the k x k matrices
    of counts, sums, squares and products over the rows where both columns are
    present (four matrix products per batch); one row per pair and task is shuffled
    and summed. NULL when a column is constant on the pair's rows, or they are fewer
    than two. Infinite values count as missing. Output (pair, feature1, feature2, correlation).
    """
    df = normalise_missing(df)
    cols = list(cols) if cols is not None else numeric_columns(df)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "pair int, feature1 string, feature2 string, correlation double")
    numbers = df.select(*[c(x).cast("double").alias(f"v{i}") for i, x in enumerate(cols)])
    finite = lambda x: F.when(F.abs(x) < F.lit(float("inf")), F.col(x))
    mean = numbers.agg(*[F.avg(finite(x)).alias(x) for x in numbers.columns]).first()
    centre = [m if m is not None else 0.0 for m in mean]
    k = len(cols)

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((6, k, k))
        for batch in batches:
            x = np.column_stack([col.to_numpy(zero_copy_only=False).astype(float) for col in batch.columns]) - centre
            here = np.isfinite(x)
            x = np.where(here, x, 0.0)
            m = here.astype(float)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        at = np.triu_indices(k, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at[0])), pa.int32()), *[pa.array(t[at]) for t in total]],
                                         names=["pair", "n", "sx", "sy", "sxx", "syy", "sxy"])

    fields = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    total = (numbers.mapInArrow(sums, "pair int, " + ", ".join(f"{f} double" for f in fields))
             .groupBy("pair").agg(*[F.sum(f).alias(f) for f in fields]))
    vx, vy = F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy")
    varies = (F.col("n") > 1) & (vx > F.expr("1e-13 * n * sxx")) & (vy > F.expr("1e-13 * n * syy"))
    r = F.when(varies, F.expr("n * sxy - sx * sy") / (F.sqrt(vx) * F.sqrt(vy)))
    names = spark.createDataFrame([(p, cols[i], cols[j]) for p, (i, j) in enumerate(pairs)],
                                  "pair int, feature1 string, feature2 string")
    # One row per pair of columns.
    return total.join(F.broadcast(names), "pair").select("pair", "feature1", "feature2", r.alias("correlation"))


def top_correlations(df: DataFrame, cols=None, k: int = 10) -> DataFrame:
    """Pairs by |r| rounded to 3 decimals, descending; ties keep pair order (K1)."""
    r3 = F.bround(F.col("correlation"), 3)
    out = (correlations(df, cols).where(F.col("correlation").isNotNull())
           .withColumn("correlation", r3)
           .orderBy(F.abs(F.col("correlation")).desc(), F.col("pair").asc()).limit(k))
    w = Window.orderBy(F.abs(F.col("correlation")).desc(), F.col("pair").asc())
    # ``out`` holds at most k rows, so this unpartitioned window is bounded by k.
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).drop("pair")


# ---------------------------------------------------------------- categorical
def top_values(df: DataFrame, cols=None, k: int = 5) -> DataFrame:
    """Top k values per categorical column, count desc then value asc.

    ``row_number() <= k`` lets Spark insert a partial window-group limit before
    the shuffle, so only k rows per column and task travel.
    """
    df = normalise_missing(df)
    cols = list(cols) if cols is not None else categorical_columns(df)
    vc = value_counts(df, cols)
    # NULL groups rank last and are dropped after the window, so this plan shares
    # its value-count exchange with other consumers of ``value_counts``.
    w = Window.partitionBy("column").orderBy(F.col("value").isNull(), F.col("count").desc(),
                                             F.col("value").asc())
    return (vc.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where((F.col("rank") <= k) & F.col("value").isNotNull()))


LONG_TEXT_AVG_LENGTH = 64.0  # "auto": columns with a longer mean length use the hashed top values


def categorical_summary(df: DataFrame, cols=None, k: int = 5, hashed_cols=None) -> DataFrame:
    """Top values with the column's distinct and missing counts attached.

    ``hashed_cols`` (a list, or "auto" = string columns whose mean length
    exceeds 64) take :func:`top_values_hashed` and :func:`column_counts`, so
    long texts are not shuffled; the other columns share one value-count frame.
    """
    df = normalise_missing(df)
    cols = list(cols) if cols is not None else categorical_columns(df)
    if hashed_cols == "auto":
        strings = [x for x in cols if type_class(df.schema[x].dataType) == "categorical"]
        hashed_cols = []
        if strings:
            row = df.agg(*[F.avg(F.length(c(x))).alias(f"l{i}") for i, x in enumerate(strings)]).first()
            hashed_cols = [x for i, x in enumerate(strings)
                           if row[f"l{i}"] is not None and row[f"l{i}"] > LONG_TEXT_AVG_LENGTH]
    hashed_cols = [x for x in (hashed_cols or []) if x in cols]
    plain = [x for x in cols if x not in hashed_cols]
    out = None
    if plain:
        vc = value_counts(df, plain)
        per_col = vc.groupBy("column").agg(
            F.count_if(F.col("value").isNotNull()).alias("n_unique"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).cast("bigint")
             .alias("n_missing"))
        w = Window.partitionBy("column").orderBy(F.col("value").isNull(), F.col("count").desc(),
                                                 F.col("value").asc())
        top = (vc.withColumn("rank", F.row_number().over(w).cast("bigint"))
               .where((F.col("rank") <= k) & F.col("value").isNotNull()))
        # ``per_col`` has one row per column.
        out = top.join(F.broadcast(per_col), "column")
    if hashed_cols:
        spark = df.sparkSession
        counts = {r["column"]: r for r in column_counts(df, hashed_cols).collect()}
        rows = []
        for x in hashed_cols:
            for i, r in enumerate(top_values_hashed(df, x, k).collect()):
                rows.append((x, r["value"], r["count"], i + 1, counts[x]["n_distinct"], counts[x]["n_missing"]))
        part = spark.createDataFrame(rows, "column string, value string, count bigint, rank bigint, "
                                           "n_unique bigint, n_missing bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame(
            [], "column string, value string, count bigint, rank bigint, n_unique bigint, n_missing bigint")
    return out


# ---------------------------------------------------------------- outliers
def iqr_bounds(df: DataFrame, cols=None, approx: bool = False) -> dict:
    """Fit step: {column: (q1, q3, lower, upper)}; bounded by the number of columns."""
    df = normalise_missing(df)
    cols = list(cols) if cols is not None else numeric_columns(df)
    qs = quantiles(df, cols, [0.25, 0.75], "approx" if approx else "brackets")
    out = {}
    for name in cols:
        q1, q3 = qs[name]
        if q1 is None:
            continue
        iqr = q3 - q1
        out[name] = (q1, q3, q1 - 1.5 * iqr, q3 + 1.5 * iqr)
    return out


def iqr_outliers(df: DataFrame, cols=None, approx: bool = False) -> DataFrame:
    """(column, n_outliers, outlier_pct, lower_bound, upper_bound) for columns with
    at least one value outside Q1 - 1.5 IQR .. Q3 + 1.5 IQR (A12, P7).

    Two jobs: quartiles (fit), then one conditional count per column with the
    bounds as literals. Percent is of all rows, missing included.
    """
    df = normalise_missing(df)
    bounds = iqr_bounds(df, cols, approx)
    spark = df.sparkSession
    schema = ("column string, n_outliers bigint, outlier_pct double, "
              "lower_bound double, upper_bound double")
    if not bounds:
        return spark.createDataFrame([], schema)
    names = list(bounds)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, name in enumerate(names):
        _, _, lo, hi = bounds[name]
        x = c(name).cast("double")
        aggs.append(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"o{i}"))
    structs = [F.struct(F.lit(n).alias("column"), F.col(f"o{i}").alias("n_outliers"),
                        F.try_divide(F.col(f"o{i}") * 100.0, F.col("__n")).alias("outlier_pct"),
                        F.lit(bounds[n][2]).alias("lower_bound"),
                        F.lit(bounds[n][3]).alias("upper_bound"))
               for i, n in enumerate(names)]
    return _explode_rows(df.agg(*aggs), structs).where(F.col("n_outliers") > 0)


def outlier_rows(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """The rows of ``df`` whose ``column`` lies outside the IQR fences."""
    df = normalise_missing(df)
    b = iqr_bounds(df, [column], approx).get(column)
    if b is None:
        return df.limit(0)
    x = c(column).cast("double")
    return df.where((x < F.lit(b[2])) | (x > F.lit(b[3])))


# ---------------------------------------------------------------- target
def target_kind(df: DataFrame, target: str, max_classes: int = 20) -> str:
    """'categorical' when the target is a string or has <= 20 distinct values."""
    df = normalise_missing(df)
    if type_class(df.schema[target].dataType) == "categorical":
        return "categorical"
    # Stop counting as soon as more than max_classes distinct values exist.
    n = df.select(c(target)).where(c(target).isNotNull()).distinct().limit(max_classes + 1).count()
    return "categorical" if n <= max_classes else "continuous"


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """(value, count, n_classes, is_imbalanced) for a categorical target."""
    df = normalise_missing(df)
    counts = (df.where(c(target).isNotNull())
              .groupBy(c(target).cast("string").alias("value"))
              .agg(F.count(F.lit(1)).alias("count")))
    s = counts.agg(F.count(F.lit(1)).alias("k"), F.max("count").alias("mx"),
                   F.min("count").alias("mn")).first()
    imbalanced = bool(s["k"]) and (s["mx"] / s["mn"] > 3)
    return counts.select("value", "count", F.lit(s["k"]).cast("bigint").alias("n_classes"),
                         F.lit(imbalanced).alias("is_imbalanced"))


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """mean, std (n-1), min, max of a continuous target."""
    df = normalise_missing(df)
    x = c(target).cast("double")
    return df.agg(F.lit(target).alias("column"), F.avg(x).alias("mean"),
                  F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def target_profile(df: DataFrame, target: str | None = None):
    """Dispatch on the target's kind; returns (kind, frame). Default target: last column."""
    target = target or df.columns[-1]
    kind = target_kind(df, target)
    if kind == "categorical":
        return kind, target_distribution(df, target)
    return kind, target_stats(df, target)


# ---------------------------------------------------------------- histogram / patterns
def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram (A27): (bin, bin_lo, bin_hi, count), all bins listed.

    bin = least(floor((x - min) / (max - min) * bins), bins - 1); a constant
    column puts everything in bin 0.
    """
    df = normalise_missing(df)
    x = c(column).cast("double")
    mm = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx")).first()
    spark = df.sparkSession
    if mm["mn"] is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, count bigint")
    mn, mx = float(mm["mn"]), float(mm["mx"])
    span = mx - mn
    if span == 0:
        b = F.lit(0)
    else:
        b = F.least(F.floor((x - F.lit(mn)) / F.lit(span) * F.lit(float(bins))).cast("int"),
                    F.lit(bins - 1))
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    width = span / bins
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (all_bins.join(counts, "bin", "left")
            .select("bin",
                    (F.lit(mn) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    (F.lit(mn) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def null_patterns(df: DataFrame) -> DataFrame:
    """Missingness map (A28): one row per distinct null pattern with its row count."""
    df = normalise_missing(df)
    flags = [c(n).isNull().alias(f"{n}_missing") for n in df.columns]
    return df.groupBy(*flags).agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- quality report
def quality_report(df: DataFrame) -> DataFrame:
    """Quality report (V10): one row combining A2-A8.

    :func:`column_counts` gives rows, missing and distinct counts for every
    column at once (hashed values, exact), :func:`duplicate_counts` the
    duplicate rows. The per-column results (bounded by the schema) are
    assembled on the driver.
    """
    df = normalise_missing(df)
    spark = df.sparkSession
    kinds = _schema_kinds(df)
    names = [f.name for f in df.schema.fields if value_comparable(df, f.name) is not None]
    nested = [f.name for f in df.schema.fields if f.name not in names]
    prof = {r["column"]: r for r in column_counts(df, names).collect()}
    nested_missing = {}
    if nested:
        row = df.agg(*[F.count_if(c(x).isNull()).alias(f"m{i}") for i, x in enumerate(nested)]).first()
        nested_missing = {x: row[f"m{i}"] for i, x in enumerate(nested)}
    dup = duplicate_counts(df).first()
    n = dup["n_rows"]
    ncols = len(df.columns)
    missing = {x: (prof[x]["n_missing"] if x in prof else nested_missing.get(x, 0)) for x in df.columns}
    total_missing = sum(missing.values())
    with_missing = [x for x in df.columns if missing[x] > 0]

    def distinct(x):
        return prof[x]["n_distinct"] if x in prof else None

    constant = [x for x in names if distinct(x) <= 1] if n else list(names)
    high = [x for x in names if kinds[x] == "categorical" and n and distinct(x) > n * 0.5]
    ids = [x for x in names if n and distinct(x) == n]
    row = (n, ncols, (total_missing * 100.0 / (n * ncols)) if n and ncols else None,
           len(with_missing), ",".join(with_missing), dup["n_duplicates"],
           (dup["n_duplicates"] * 100.0 / n) if n else None,
           ",".join(constant), ",".join(high), ",".join(ids))
    schema = ("n_rows bigint, n_columns int, missing_cell_pct double, n_columns_with_missing int, "
              "columns_with_missing string, n_duplicates bigint, duplicate_pct double, "
              "constant_features string, high_cardinality_features string, potential_id_columns string")
    return spark.createDataFrame([row], schema)
