"""Contract queries for time-series profiling on the daily orders series.

Outputs are rounded to 10 significant digits. The oracle's rolling means use
``list_avg`` over the window frame, which sums the frame in row order as
Spark's sliding frame does (DuckDB's windowed ``avg`` uses a different
summation order and differs in the last bits).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..operators.ordering import row_index
from ..sources.scan import DIRTY_EVENTS_NORM_SQL, DIRTY_EVENTS_SQL, dirty_events, read_table
from .common import round_sig_doubles as round_doubles
from .common import rsig as rnd
from .registry import register


def daily_orders(spark, sf):
    """Fixture: total order value per order date -> (o_orderdate, value)."""
    orders = read_table(spark, sf, "orders")
    return orders.groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("value"))


DAILY_SQL = "(SELECT o_orderdate, sum(o_totalprice) AS value FROM orders GROUP BY o_orderdate)"
IDX_SQL = (f"(SELECT o_orderdate AS ts, value, row_number() OVER (ORDER BY o_orderdate, value) - 1"
           f" AS idx FROM {DAILY_SQL} WHERE value IS NOT NULL)")


@register("ts_date_range", f"""
SELECT 'o_orderdate' AS time_column, min(o_orderdate) AS start, max(o_orderdate) AS "end",
       CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000.0) AS BIGINT)
         AS duration_days
FROM {DAILY_SQL}""")
def ts_date_range(spark, sf):
    df = daily_orders(spark, sf)
    return S.date_range(df, S.detect_time_column(df))


@register("ts_frequency", f"""
WITH d AS (SELECT epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER (ORDER BY o_orderdate)) AS d
           FROM {DAILY_SQL} WHERE o_orderdate IS NOT NULL),
c AS (SELECT d, count(*) AS n_steps FROM d WHERE d IS NOT NULL GROUP BY d
      ORDER BY n_steps DESC, d LIMIT 1)
SELECT d / 1000000.0 AS step_seconds, n_steps,
       CASE WHEN d = 0 THEN NULL WHEN d <= 3600000000 THEN 'hourly'
            WHEN d <= 86400000000 THEN 'daily' WHEN d <= 604800000000 THEN 'weekly'
            ELSE 'monthly or longer' END AS frequency
FROM c""")
def ts_frequency(spark, sf):
    df = daily_orders(spark, sf)
    return S.frequency(df, S.detect_time_column(df))


@register("ts_value_stats", f"""
SELECT count(value) AS n, {rnd('avg(value)')} AS mean, {rnd('stddev_samp(value)')} AS std,
       {rnd('min(value)')} AS min, {rnd('max(value)')} AS max, {rnd('median(value)')} AS median
FROM {DAILY_SQL} WHERE value IS NOT NULL""")
def ts_value_stats(spark, sf):
    return round_doubles(S.value_stats(S.as_series(daily_orders(spark, sf))))


@register("ts_trend", f"""
SELECT count(*) AS n, {rnd('regr_slope(value, idx)')} AS slope, {rnd('stddev_samp(value)')} AS std,
       CASE WHEN count(*) <= 10 THEN NULL
            WHEN abs(regr_slope(value, idx)) < stddev_samp(value) * 0.01 THEN 'no clear trend'
            WHEN regr_slope(value, idx) > 0 THEN 'upward trend' ELSE 'downward trend' END AS trend
FROM {IDX_SQL}""")
def ts_trend(spark, sf):
    return round_doubles(S.trend(S.as_series(daily_orders(spark, sf))))


@register("ts_stationarity", f"""
WITH n AS (SELECT count(*) AS n FROM {IDX_SQL}),
v AS (SELECT var_samp(value) FILTER (WHERE idx < n.n // 2) AS a,
             var_samp(value) FILTER (WHERE idx >= n.n // 2) AS b, any_value(n.n) AS n
      FROM {IDX_SQL}, n)
SELECT CAST(n AS BIGINT) AS n, {rnd('a')} AS first_half_var, {rnd('b')} AS second_half_var,
       CASE WHEN n > 20 THEN {rnd('greatest(a, b) / (least(a, b) + 1e-10)')} END AS variance_ratio,
       CASE WHEN n > 20 THEN greatest(a, b) / (least(a, b) + 1e-10) < 2 END AS likely_stationary
FROM v""")
def ts_stationarity(spark, sf):
    return round_doubles(S.stationarity(S.as_series(daily_orders(spark, sf))))


@register("ts_rolling30", f"""
WITH n AS (SELECT count(*) AS n FROM {IDX_SQL})
SELECT ts, {rnd('value')} AS value, idx,
       CASE WHEN count(*) OVER w >= least(30, n.n // 5)
            THEN {rnd('list_avg(list(value) OVER w)')} END AS rolling_mean,
       CASE WHEN count(*) OVER w >= least(30, n.n // 5)
            THEN {rnd('stddev_samp(value) OVER w')} END AS rolling_std,
       CAST(least(30, n.n // 5) AS INTEGER) AS "window"
FROM {IDX_SQL}, n
WINDOW w AS (ORDER BY idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def ts_rolling30(spark, sf):
    return round_doubles(S.rolling_stats(S.as_series(daily_orders(spark, sf))))


@register("ts_lag_features", f"""
SELECT ts, {rnd('value')} AS value, idx,
       {rnd('lag(value, 1) OVER (ORDER BY idx)')} AS lag_1,
       {rnd('lag(value, 7) OVER (ORDER BY idx)')} AS lag_7,
       CASE WHEN count(*) OVER w7 >= 7 THEN {rnd('list_avg(list(value) OVER w7)')} END AS rolling_mean_7,
       CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month
FROM {IDX_SQL}
WINDOW w7 AS (ORDER BY idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def ts_lag_features(spark, sf):
    return round_doubles(S.lag_features(S.as_series(daily_orders(spark, sf))))


def daily_orders_by_status(spark, sf):
    """Fixture: one daily series per order status -> (o_orderstatus, o_orderdate, value)."""
    orders = read_table(spark, sf, "orders")
    return orders.groupBy("o_orderstatus", "o_orderdate").agg(F.sum("o_totalprice").alias("value"))


@register("ts_rolling_by_series", f"""
WITH d AS (SELECT o_orderstatus, o_orderdate AS ts, sum(o_totalprice) AS value
           FROM orders GROUP BY o_orderstatus, o_orderdate),
ix AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY ts, value) - 1 AS idx
       FROM d WHERE value IS NOT NULL)
SELECT o_orderstatus, ts, {rnd('value')} AS value, idx,
       CASE WHEN count(*) OVER w >= 7 THEN {rnd('list_avg(list(value) OVER w)')} END AS rolling_mean,
       CASE WHEN count(*) OVER w >= 7 THEN {rnd('stddev_samp(value) OVER w')} END AS rolling_std,
       7 AS "window"
FROM ix WINDOW w AS (PARTITION BY o_orderstatus ORDER BY idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def ts_rolling_by_series(spark, sf):
    """7-row rolling mean and std within each order-status series (W1, W2 per series)."""
    s = S.as_series(daily_orders_by_status(spark, sf), "o_orderdate", "value", ["o_orderstatus"])
    return round_doubles(S.rolling_stats(s, window=7, series_cols=["o_orderstatus"]))


@register("ts_frequency_by_series", """
WITH d AS (SELECT o_orderstatus, o_orderdate FROM orders WHERE o_orderdate IS NOT NULL
           GROUP BY o_orderstatus, o_orderdate),
s AS (SELECT o_orderstatus, epoch_us(o_orderdate)
             - epoch_us(lag(o_orderdate) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate)) AS d FROM d),
c AS (SELECT o_orderstatus, d, count(*) AS n_steps FROM s WHERE d IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n_steps DESC, d) AS rn FROM c)
SELECT o_orderstatus, d / 1000000.0 AS step_seconds, n_steps,
       CASE WHEN d = 0 THEN NULL WHEN d <= 3600000000 THEN 'hourly'
            WHEN d <= 86400000000 THEN 'daily' WHEN d <= 604800000000 THEN 'weekly'
            ELSE 'monthly or longer' END AS frequency
FROM r WHERE rn = 1""")
def ts_frequency_by_series(spark, sf):
    """Most common step of each order-status daily series (A16, W1 per series)."""
    d = daily_orders_by_status(spark, sf)
    return S.frequency(d, "o_orderdate", series_cols=["o_orderstatus"])


@register("ts_trend_by_series", f"""
WITH d AS (SELECT o_orderstatus, o_orderdate AS ts, sum(o_totalprice) AS value
           FROM orders GROUP BY o_orderstatus, o_orderdate),
ix AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY ts, value) - 1 AS idx
       FROM d WHERE value IS NOT NULL)
SELECT o_orderstatus, count(*) AS n, {rnd('regr_slope(value, idx)')} AS slope,
       {rnd('stddev_samp(value)')} AS std,
       CASE WHEN count(*) <= 10 THEN NULL
            WHEN abs(regr_slope(value, idx)) < stddev_samp(value) * 0.01 THEN 'no clear trend'
            WHEN regr_slope(value, idx) > 0 THEN 'upward trend' ELSE 'downward trend' END AS trend
FROM ix GROUP BY o_orderstatus""")
def ts_trend_by_series(spark, sf):
    """Least-squares trend of each order-status daily series (A18 per series)."""
    s = S.as_series(daily_orders_by_status(spark, sf), "o_orderdate", "value", ["o_orderstatus"])
    return round_doubles(S.trend(s, ["o_orderstatus"]))


IDX_BY_STATUS_SQL = """(SELECT o_orderstatus, ts, value,
       row_number() OVER (PARTITION BY o_orderstatus ORDER BY ts, value) - 1 AS idx
  FROM (SELECT o_orderstatus, o_orderdate AS ts, sum(o_totalprice) AS value FROM orders
        GROUP BY o_orderstatus, o_orderdate) WHERE value IS NOT NULL)"""


@register("ts_value_stats_by_series", f"""
SELECT o_orderstatus, count(value) AS n, {rnd('avg(value)')} AS mean, {rnd('stddev_samp(value)')} AS std,
       {rnd('min(value)')} AS min, {rnd('max(value)')} AS max, {rnd('median(value)')} AS median
FROM {IDX_BY_STATUS_SQL} GROUP BY o_orderstatus""")
def ts_value_stats_by_series(spark, sf):
    """Value statistics of each order-status daily series (A17 per series)."""
    s = S.as_series(daily_orders_by_status(spark, sf), "o_orderdate", "value", ["o_orderstatus"])
    return round_doubles(S.value_stats(s, ["o_orderstatus"]))


@register("ts_stationarity_by_series", f"""
WITH ix AS {IDX_BY_STATUS_SQL},
n AS (SELECT o_orderstatus, count(*) AS n FROM ix GROUP BY o_orderstatus),
v AS (SELECT o_orderstatus, any_value(n.n) AS n,
             var_samp(value) FILTER (WHERE idx < n.n // 2) AS a,
             var_samp(value) FILTER (WHERE idx >= n.n // 2) AS b
      FROM ix JOIN n USING (o_orderstatus) GROUP BY o_orderstatus)
SELECT o_orderstatus, CAST(n AS BIGINT) AS n, {rnd('a')} AS first_half_var, {rnd('b')} AS second_half_var,
       CASE WHEN n > 20 THEN {rnd('greatest(a, b) / (least(a, b) + 1e-10)')} END AS variance_ratio,
       CASE WHEN n > 20 THEN greatest(a, b) / (least(a, b) + 1e-10) < 2 END AS likely_stationary
FROM v""")
def ts_stationarity_by_series(spark, sf):
    """Half-against-half variance check of each order-status daily series (A19 per series)."""
    s = S.as_series(daily_orders_by_status(spark, sf), "o_orderdate", "value", ["o_orderstatus"])
    return round_doubles(S.stationarity(s, ["o_orderstatus"]))


@register("ts_date_range_by_series", """
SELECT o_orderstatus, 'o_orderdate' AS time_column, min(o_orderdate) AS start, max(o_orderdate) AS "end",
       CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000.0) AS BIGINT)
         AS duration_days
FROM orders GROUP BY o_orderstatus""")
def ts_date_range_by_series(spark, sf):
    """Date range of each order-status daily series (A15 per series)."""
    return S.date_range(daily_orders_by_status(spark, sf), "o_orderdate", ["o_orderstatus"])


@register("ts_lag_by_series", f"""
SELECT o_orderstatus, ts, {rnd('value')} AS value, idx,
       {rnd('lag(value, 1) OVER (PARTITION BY o_orderstatus ORDER BY idx)')} AS lag_1,
       {rnd('lag(value, 7) OVER (PARTITION BY o_orderstatus ORDER BY idx)')} AS lag_7,
       CASE WHEN count(*) OVER w7 >= 7 THEN {rnd('list_avg(list(value) OVER w7)')} END AS rolling_mean_7,
       CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month
FROM {IDX_BY_STATUS_SQL}
WINDOW w7 AS (PARTITION BY o_orderstatus ORDER BY idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def ts_lag_by_series(spark, sf):
    """Lag 1 / 7, 7-row rolling mean and calendar fields within each order-status series."""
    s = S.as_series(daily_orders_by_status(spark, sf), "o_orderdate", "value", ["o_orderstatus"])
    return round_doubles(S.lag_features(s, series_cols=["o_orderstatus"]))


# ---------------------------------------------------------------- groups without a name
NULL_SERIES_SQL = f"(SELECT event_type, ts, value FROM {DIRTY_EVENTS_NORM_SQL} WHERE ts IS NOT NULL AND value IS NOT NULL)"


@register("row_index_null_groups", f"""
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx
FROM {DIRTY_EVENTS_SQL}""")
def row_index_null_groups(spark, sf):
    """Positions within groups, one of them NULL, by the range-partitioned path that large tables take."""
    ev = dirty_events(spark, sf)
    n = ev.count()
    out = row_index(ev, ["ts", "event_id"], ["event_type"], out="idx", rows_per_range=max(1, -(-n // 8)))
    return out.select("event_id", "event_type", "idx")


@register("ts_stationarity_null_series", f"""
WITH i AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) - 1 AS idx,
                  count(*) OVER (PARTITION BY event_type) AS n FROM {NULL_SERIES_SQL}),
h AS (SELECT event_type, any_value(n) AS n, var_samp(value) FILTER (WHERE idx < n // 2) AS a,
             var_samp(value) FILTER (WHERE idx >= n // 2) AS b FROM i GROUP BY event_type)
SELECT event_type, CAST(n AS BIGINT) AS n, {rnd('a')} AS first_half_var, {rnd('b')} AS second_half_var,
       {rnd('CASE WHEN n > 20 THEN greatest(a, b) / (least(a, b) + 1e-10) END')} AS variance_ratio,
       CASE WHEN n > 20 THEN greatest(a, b) / (least(a, b) + 1e-10) < 2 END AS likely_stationary
FROM h""")
def ts_stationarity_null_series(spark, sf):
    """Stationarity of the event values per type; the events without a type are a series, too."""
    ev = dirty_events(spark, sf)
    series = S.as_series(ev, "ts", "value", ["event_type"])
    return round_doubles(S.stationarity(series, ["event_type"]))
