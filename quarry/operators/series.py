"""Time-series profiling and features.

The series is ordered by time (the reference uses file order, which a
distributed table does not have). Positions come from
:func:`ordering.row_index`, never from an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TS_TIME_NAMES, c, datetime_columns, numeric_columns
from ..sources.scan import normalise_missing
from .ordering import IDX, blocked_window, join_groups, rolling, row_index
from .quantiles import quantiles

MICROS_PER_DAY = 86_400_000_000
MICROS_PER_HOUR = 3_600_000_000


def detect_time_column(df: DataFrame) -> str | None:
    """First datetime column; else a time-named string column whose every
    non-null value parses as a timestamp (one job per candidate name)."""
    for f in df.schema.fields:
        if f.name in datetime_columns(df):
            return f.name
        if f.name.lower() in TS_TIME_NAMES:
            bad = df.where(c(f.name).isNotNull() &
                           F.try_to_timestamp(c(f.name).cast("string")).isNull()).limit(1).count()
            if bad == 0:
                return f.name
    return None


def as_series(df: DataFrame, ts: str | None = None, value: str | None = None,
              series_cols=()) -> DataFrame:
    """(series..., ts, value) with the time column parsed (P6 drops missing values later).

    ``series_cols`` name a series key when the table holds several series; the
    reference profiles one series, which is the default.
    """
    df = normalise_missing(df)
    ts = ts or detect_time_column(df)
    value = value or numeric_columns(df, tuple(series_cols))[0]
    t = c(ts) if ts in datetime_columns(df) else F.try_to_timestamp(c(ts).cast("string"))
    return df.select(*[c(x) for x in series_cols], t.cast("timestamp").alias("ts"),
                     c(value).cast("double").alias("value"))


def date_range(df: DataFrame, ts: str, series_cols=()) -> DataFrame:
    """start, end and whole elapsed days (floor, not calendar days) (A15);
    one row per series with ``series_cols``."""
    t = c(ts).cast("timestamp")
    aggs = [F.min(t).alias("start"), F.max(t).alias("end")]
    mm = df.groupBy(*series_cols).agg(*aggs) if series_cols else df.agg(*aggs)
    days = F.floor((F.unix_micros("end") - F.unix_micros("start")) / F.lit(MICROS_PER_DAY))
    return mm.select(*series_cols, F.lit(ts).alias("time_column"), "start", "end",
                     days.cast("bigint").alias("duration_days"))


def _classify(micros: F.Column) -> F.Column:
    return (F.when(micros.isNull() | (micros == 0), F.lit(None).cast("string"))
            .when(micros <= MICROS_PER_HOUR, "hourly")
            .when(micros <= MICROS_PER_DAY, "daily")
            .when(micros <= 7 * MICROS_PER_DAY, "weekly")
            .otherwise("monthly or longer"))


def frequency(df: DataFrame, ts: str, tiebreak: list[str] | None = None, series_cols=()) -> DataFrame:
    """Most common step between successive timestamps (smallest on ties) and its
    class (A16, W1). One row: (step_seconds, n_steps, frequency); one row per
    series when ``series_cols`` are given (steps never cross series)."""
    series_cols = list(series_cols)
    t = df.select(*[c(x) for x in series_cols], c(ts).cast("timestamp").alias("__t"),
                  *[c(x) for x in (tiebreak or [])]).where(F.col("__t").isNotNull())
    indexed = row_index(t, ["__t"] + list(tiebreak or []), partition_cols=series_cols or None)
    diffs = blocked_window(indexed, IDX, 1, {
        "__d": lambda w: F.unix_micros("__t") - F.unix_micros(F.lag("__t", 1).over(w))},
        partition_cols=series_cols)
    counts = (diffs.where(F.col("__d").isNotNull()).groupBy(*series_cols, "__d")
              .agg(F.count(F.lit(1)).alias("n_steps")))
    out = [(F.col("__d") / F.lit(1_000_000.0)).alias("step_seconds"), "n_steps",
           _classify(F.col("__d")).alias("frequency")]
    if not series_cols:
        return counts.orderBy(F.col("n_steps").desc(), F.col("__d").asc()).limit(1).select(*out)
    from pyspark.sql import Window
    w = Window.partitionBy(*series_cols).orderBy(F.col("n_steps").desc(), F.col("__d").asc())
    return (counts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= 1)
            .select(*series_cols, *out))


def value_stats(series: DataFrame, series_cols=()) -> DataFrame:
    """mean, std (n-1), min, max, median of ``value`` (A17); per series with ``series_cols``.

    The median of the whole frame comes from :func:`quantiles.quantiles`; per series it is the
    middle one or two positions of the distributed row index, so no task holds a series."""
    v = F.col("value")
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max")]
    s = series.where(v.isNotNull())
    if not series_cols:
        median = quantiles(s, ["value"], [0.5])["value"][0]
        return s.agg(*aggs).withColumn("median", F.lit(median).cast("double"))
    keys = list(series_cols)
    stats = s.groupBy(*keys).agg(*aggs)
    ix = row_index(s.select(*keys, "value"), ["value"], partition_cols=keys)
    sizes = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    same = None
    for i, k in enumerate(keys):
        one = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        same = one if same is None else same & one
    middle = (ix.join(stats.select(*sizes, F.col("n").alias("__n")), same)
              .where(F.col(IDX).between(F.floor((F.col("__n") - 1) / 2), F.ceil((F.col("__n") - 1) / 2)))
              .groupBy(*[f"__k{i}" for i in range(len(keys))])
              .agg(F.avg(F.col("value").cast("double")).alias("median")))
    return stats.join(middle, same).drop(*[f"__k{i}" for i in range(len(keys))])


def indexed(series: DataFrame, series_cols=()) -> DataFrame:
    """Series rows with a value, each with its position in time order (W3),
    counted within each series when ``series_cols`` are given."""
    s = series.where(F.col("value").isNotNull())
    return row_index(s, ["ts", "value"], partition_cols=list(series_cols) or None)


def trend(series: DataFrame, series_cols=()) -> DataFrame:
    """Least-squares slope of value on position; class when more than 10 rows.
    One row, or one row per series (a grouped aggregate) with ``series_cols``."""
    series_cols = list(series_cols)
    ix = indexed(series, series_cols)
    aggs = [F.count(F.lit(1)).alias("n"),
            F.regr_slope(F.col("value"), F.col(IDX).cast("double")).alias("slope"),
            F.stddev_samp("value").alias("std")]
    agg = ix.groupBy(*series_cols).agg(*aggs) if series_cols else ix.agg(*aggs)
    label = (F.when(F.col("n") <= 10, F.lit(None).cast("string"))
             .when(F.abs("slope") < F.col("std") * 0.01, "no clear trend")
             .when(F.col("slope") > 0, "upward trend").otherwise("downward trend"))
    return agg.select(*series_cols, "n", "slope", "std", label.alias("trend"))


def stationarity(series: DataFrame, series_cols=()) -> DataFrame:
    """Variance (n-1) of the first n div 2 values against the rest.

    ratio = max / (min + 1e-10); likely stationary when < 2; needs > 20 rows.
    With ``series_cols`` each series is split at its own half: its length joins
    back from a grouped count (size-checked broadcast, one row per series).
    """
    series_cols = list(series_cols)
    if series_cols:
        from .features import sized
        ix = indexed(series, series_cols)
        n = ix.groupBy(*series_cols).agg(F.count(F.lit(1)).alias("n"))
        j = join_groups(ix, sized(n), series_cols)
        first = F.col(IDX) < F.floor(F.col("n") / 2)
        agg = j.groupBy(*series_cols).agg(
            F.first("n").alias("n"),
            F.var_samp(F.when(first, F.col("value"))).alias("first_half_var"),
            F.var_samp(F.when(~first, F.col("value"))).alias("second_half_var"))
        ratio = (F.greatest("first_half_var", "second_half_var") /
                 (F.least("first_half_var", "second_half_var") + F.lit(1e-10)))
        ok = F.col("n") > 20
        return agg.select(*series_cols, F.col("n").cast("bigint").alias("n"), "first_half_var",
                          "second_half_var", F.when(ok, ratio).alias("variance_ratio"),
                          F.when(ok, ratio < 2).alias("likely_stationary"))
    ix = indexed(series)
    total = ix.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    half = total // 2
    first = F.col(IDX) < F.lit(half)
    agg = ix.agg(F.var_samp(F.when(first, F.col("value"))).alias("first_half_var"),
                 F.var_samp(F.when(~first, F.col("value"))).alias("second_half_var"))
    ratio = (F.greatest("first_half_var", "second_half_var") /
             (F.least("first_half_var", "second_half_var") + F.lit(1e-10)))
    ok = F.lit(total > 20)
    return agg.select(F.lit(total).cast("bigint").alias("n"), "first_half_var", "second_half_var",
                      F.when(ok, ratio).alias("variance_ratio"),
                      F.when(ok, ratio < 2).alias("likely_stationary"))


def rolling_stats(series: DataFrame, window: int | None = None, block: int = 100_000,
                  series_cols=()) -> DataFrame:
    """Rolling mean and std (n-1) over ``min(30, n div 5)`` rows, only when
    n > 30; NULL until the window is full (W2). With ``series_cols`` the
    window runs within each series (``window`` must then be given)."""
    series_cols = list(series_cols)
    ix = indexed(series, series_cols)
    keys = [c(x) for x in series_cols]
    if window is None:
        if series_cols:
            raise ValueError("give the window size when rolling several series")
        n = ix.count()
        size = min(30, n // 5)
        if n <= 30:
            return ix.limit(0).select("ts", "value", F.col(IDX).alias("idx"),
                                      F.lit(None).cast("double").alias("rolling_mean"),
                                      F.lit(None).cast("double").alias("rolling_std"),
                                      F.lit(size).alias("window"))
    else:
        size = window
    v = F.col("value")
    out = blocked_window(ix, IDX, size - 1, {
        "rolling_mean": lambda w: rolling(w, v, size, "mean"),
        "rolling_std": lambda w: rolling(w, v, size, "std")}, partition_cols=series_cols, block=block)
    return out.select(*keys, "ts", "value", F.col(IDX).alias("idx"), "rolling_mean", "rolling_std",
                      F.lit(size).alias("window"))


def lag_features(series: DataFrame, lags=(1, 7), windows=(7,), block: int = 100_000,
                 series_cols=()) -> DataFrame:
    """Lag values, rolling means and calendar indicators (W8), per series when
    ``series_cols`` are given."""
    series_cols = list(series_cols)
    ix = indexed(series, series_cols)
    v = F.col("value")
    cols = {}
    for k in lags:
        cols[f"lag_{k}"] = (lambda kk: (lambda w: F.lag(v, kk).over(w)))(k)
    for size in windows:
        cols[f"rolling_mean_{size}"] = (lambda s: (lambda w: rolling(w, v, s, "mean")))(size)
    halo = max(list(lags) + [s - 1 for s in windows] + [0])
    out = blocked_window(ix, IDX, halo, cols, partition_cols=series_cols, block=block)
    return out.select(*[c(x) for x in series_cols], "ts", "value", F.col(IDX).alias("idx"), *cols.keys(),
                      F.dayofweek("ts").alias("day_of_week"), F.month("ts").alias("month"))
