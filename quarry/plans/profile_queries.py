"""Contract queries for tabular profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..sources.scan import DIRTY_EVENTS_NORM_SQL, dirty_events, read_table
from .common import lit, q, rnd, round_doubles, union_all
from .registry import register

EVENTS_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
EVENTS_NUMERIC = ["event_id", "user_id", "value"]
PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", "p_constant"]
PART_KINDS = {"p_partkey": "numeric", "p_name": "categorical", "p_brand": "categorical",
              "p_type": "categorical", "p_size": "numeric", "p_retailprice": "numeric",
              "p_constant": "categorical"}


# ---------------------------------------------------------------- profile_missing
def _missing_sql(src: str, cols: list[str]) -> str:
    parts = [f"SELECT {lit(col)} AS column_name, {i} AS ordinal, "
             f"count(*) FILTER (WHERE {q(col)} IS NULL) AS n_missing, count(*) AS n_rows FROM {src}"
             for i, col in enumerate(cols)]
    return f"""
WITH per_col AS ({union_all(parts)}),
tot AS (SELECT CAST(sum(n_missing) AS BIGINT) AS total_missing FROM per_col)
SELECT column_name, n_missing, {rnd('n_missing * 100.0 / n_rows')} AS missing_pct,
       total_missing, {rnd(f'total_missing * 100.0 / (n_rows * {len(cols)})')} AS cell_missing_pct
FROM per_col, tot WHERE n_missing > 0"""


@register("profile_missing", _missing_sql(DIRTY_EVENTS_NORM_SQL, EVENTS_COLS))
def profile_missing(spark, sf):
    df = P.missing_report(dirty_events(spark, sf))
    return round_doubles(df.withColumnRenamed("column", "column_name"))


# ---------------------------------------------------------------- profile_duplicates
@register("profile_duplicates", f"""
SELECT CAST(sum(k) AS BIGINT) AS n_rows, CAST(sum(k - 1) AS BIGINT) AS n_duplicates,
       {rnd('sum(k - 1) * 100.0 / sum(k)')} AS duplicate_pct
FROM (SELECT count(*) AS k FROM {DIRTY_EVENTS_NORM_SQL} GROUP BY {", ".join(EVENTS_COLS)})""")
def profile_duplicates(spark, sf):
    return round_doubles(P.duplicate_counts(dirty_events(spark, sf)))


# ---------------------------------------------------------------- profile_distinct
def _part_with_constant(spark, sf):
    """``part`` plus one literal column so the constant-column rule has a hit."""
    return read_table(spark, sf, "part").withColumn("p_constant", F.lit("x"))


PART_SRC = "(SELECT *, 'x' AS p_constant FROM part)"


def _distinct_sql(src: str, cols: list[str], kinds: dict) -> str:
    parts = [f"SELECT {lit(col)} AS column_name, {i} AS ordinal, {lit(kinds[col])} AS type_class, "
             f"count(*) AS n_rows, count(DISTINCT {q(col)}) AS n_distinct FROM {src}"
             for i, col in enumerate(cols)]
    return f"""
SELECT column_name, type_class, n_rows, n_distinct, n_distinct <= 1 AS is_constant,
       (type_class = 'categorical' AND n_distinct > n_rows * 0.5) AS is_high_cardinality,
       n_distinct = n_rows AS is_potential_id
FROM ({union_all(parts)})"""


@register("profile_distinct", _distinct_sql(PART_SRC, PART_COLS, PART_KINDS))
def profile_distinct(spark, sf):
    df = P.distinct_profile(_part_with_constant(spark, sf))
    return df.select(F.col("column").alias("column_name"), "type_class", "n_rows", "n_distinct",
                     "is_constant", "is_high_cardinality", "is_potential_id")


# ---------------------------------------------------------------- quality_report
EVENTS_KINDS = {"event_id": "numeric", "ts": "datetime", "user_id": "numeric",
                "event_type": "categorical", "value": "numeric", "props": "categorical"}


def _quality_sql(src: str, cols: list[str], kinds: dict) -> str:
    parts = [f"SELECT {lit(col)} AS column_name, {i} AS ordinal, {lit(kinds[col])} AS type_class, "
             f"count(*) AS n_rows, count(*) FILTER (WHERE {q(col)} IS NULL) AS n_missing, "
             f"count(DISTINCT {q(col)}) AS n_distinct FROM {src}"
             for i, col in enumerate(cols)]
    k = len(cols)
    return f"""
WITH per_col AS ({union_all(parts)}),
dup AS (SELECT sum(k) AS n, sum(k - 1) AS d FROM (SELECT count(*) AS k FROM {src} GROUP BY {", ".join(q(x) for x in cols)}))
SELECT CAST(dup.n AS BIGINT) AS n_rows, CAST({k} AS INTEGER) AS n_columns,
       {rnd(f'sum(n_missing) * 100.0 / (dup.n * {k})')} AS missing_cell_pct,
       CAST(count(*) FILTER (WHERE n_missing > 0) AS INTEGER) AS n_columns_with_missing,
       coalesce(string_agg(column_name, ',' ORDER BY ordinal) FILTER (WHERE n_missing > 0), '')
         AS columns_with_missing,
       CAST(dup.d AS BIGINT) AS n_duplicates, {rnd('dup.d * 100.0 / dup.n')} AS duplicate_pct,
       coalesce(string_agg(column_name, ',' ORDER BY ordinal) FILTER (WHERE n_distinct <= 1), '')
         AS constant_features,
       coalesce(string_agg(column_name, ',' ORDER BY ordinal)
         FILTER (WHERE type_class = 'categorical' AND n_distinct > per_col.n_rows * 0.5), '')
         AS high_cardinality_features,
       coalesce(string_agg(column_name, ',' ORDER BY ordinal)
         FILTER (WHERE n_distinct = per_col.n_rows), '') AS potential_id_columns
FROM per_col, dup GROUP BY dup.n, dup.d"""


@register("quality_report", _quality_sql(DIRTY_EVENTS_NORM_SQL, EVENTS_COLS, EVENTS_KINDS))
def quality_report(spark, sf):
    return round_doubles(P.quality_report(dirty_events(spark, sf)))


# ---------------------------------------------------------------- describe_numeric
def _describe_sql(table: str, cols: list[str]) -> str:
    parts = []
    for col in cols:
        x = f"CAST({q(col)} AS DOUBLE)"
        parts.append(
            f"SELECT {lit(col)} AS column_name, count({x}) AS count, {rnd(f'avg({x})')} AS mean, "
            f"{rnd(f'stddev_samp({x})')} AS std, {rnd(f'min({x})')} AS min, "
            f"{rnd(f'quantile_cont({x}, 0.25)')} AS q25, {rnd(f'quantile_cont({x}, 0.5)')} AS q50, "
            f"{rnd(f'quantile_cont({x}, 0.75)')} AS q75, {rnd(f'max({x})')} AS max FROM {table}")
    return union_all(parts)


@register("describe_numeric", _describe_sql("lineitem", LINEITEM_NUMERIC))
def describe_numeric(spark, sf):
    df = P.describe(read_table(spark, sf, "lineitem"))
    return round_doubles(df.drop("ordinal").withColumnRenamed("column", "column_name"))


# ---------------------------------------------------------------- top_correlations
def _corr_sql(table: str, cols: list[str], k: int = 10) -> str:
    parts, p = [], 0
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            x, y = f"CAST({q(a)} AS DOUBLE)", f"CAST({q(b)} AS DOUBLE)"
            r = (f"covar_samp({x}, {y}) / nullif(stddev_samp(CASE WHEN {y} IS NOT NULL THEN {x} END)"
                 f" * stddev_samp(CASE WHEN {x} IS NOT NULL THEN {y} END), 0)")
            parts.append(f"SELECT {p} AS pair, {lit(a)} AS feature1, {lit(b)} AS feature2, "
                         f"round_even({r}, 3) AS correlation FROM {table}")
            p += 1
    return f"""
SELECT feature1, feature2, correlation,
       row_number() OVER (ORDER BY abs(correlation) DESC, pair) AS rank
FROM ({union_all(parts)}) WHERE correlation IS NOT NULL
ORDER BY abs(correlation) DESC, pair LIMIT {k}"""


@register("top_correlations", _corr_sql("lineitem", LINEITEM_NUMERIC))
def top_correlations(spark, sf):
    return P.top_correlations(read_table(spark, sf, "lineitem"))


# ---------------------------------------------------------------- categorical_top_values
CAT_TABLES = {"customer": ["c_name", "c_mktsegment"], "orders": ["o_orderstatus", "o_orderpriority"]}


def _top_values_sql(tables: dict, k: int = 5) -> str:
    parts = []
    for t, cols in tables.items():
        for col in cols:
            parts.append(f"SELECT {lit(t)} AS table_name, {lit(col)} AS column_name, "
                         f"CAST({q(col)} AS VARCHAR) AS value FROM {t}")
    return f"""
WITH v AS ({union_all(parts)}),
vc AS (SELECT table_name, column_name, value, count(*) AS count FROM v GROUP BY ALL),
per_col AS (SELECT table_name, column_name, count(value) AS n_unique,
                   CAST(coalesce(sum(count) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS n_missing
            FROM vc GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name
                                        ORDER BY count DESC, value) AS rank
           FROM vc WHERE value IS NOT NULL)
SELECT r.table_name, r.column_name, r.value, r.count, r.rank, p.n_unique, p.n_missing
FROM ranked r JOIN per_col p USING (table_name, column_name) WHERE r.rank <= {k}"""


@register("categorical_top_values", _top_values_sql(CAT_TABLES))
def categorical_top_values(spark, sf):
    out = None
    for t, cols in CAT_TABLES.items():
        part = (P.categorical_summary(read_table(spark, sf, t), cols)
                .select(F.lit(t).alias("table_name"), F.col("column").alias("column_name"),
                        "value", "count", "rank", "n_unique", "n_missing"))
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- iqr_outliers
def _iqr_sql(table: str, cols: list[str]) -> str:
    parts = []
    for col in cols:
        x = f"CAST({q(col)} AS DOUBLE)"
        parts.append(
            f"SELECT {lit(col)} AS column_name, quantile_cont({x}, 0.25) AS q1, "
            f"quantile_cont({x}, 0.75) AS q3 FROM {table}")
    counts = []
    for col in cols:
        x = f"CAST({q(col)} AS DOUBLE)"
        counts.append(
            f"SELECT {lit(col)} AS column_name, count(*) FILTER (WHERE {x} < b.lo OR {x} > b.hi) "
            f"AS n_outliers, count(*) AS n, b.lo, b.hi FROM {table}, "
            f"(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM quart "
            f"WHERE column_name = {lit(col)}) b GROUP BY b.lo, b.hi")
    return f"""
WITH quart AS ({union_all(parts)}),
c AS ({union_all(counts)})
SELECT column_name, n_outliers, {rnd('n_outliers * 100.0 / n')} AS outlier_pct,
       {rnd('lo')} AS lower_bound, {rnd('hi')} AS upper_bound
FROM c WHERE n_outliers > 0"""


@register("iqr_outliers", _iqr_sql("events", EVENTS_NUMERIC))
def iqr_outliers(spark, sf):
    df = P.iqr_outliers(read_table(spark, sf, "events"))
    return round_doubles(df.withColumnRenamed("column", "column_name"))


# ---------------------------------------------------------------- target profiles
@register("target_profile_categorical", """
WITH vc AS (SELECT CAST(o_orderpriority AS VARCHAR) AS value, count(*) AS count
            FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT value, count, (SELECT count(*) FROM vc) AS n_classes,
       (SELECT max(count) * 1.0 / min(count) > 3 FROM vc) AS is_imbalanced
FROM vc""")
def target_profile_categorical(spark, sf):
    orders = read_table(spark, sf, "orders")
    kind, df = P.target_profile(orders)  # default target: last column (o_orderpriority)
    assert kind == "categorical"
    return df


@register("target_profile_continuous", f"""
SELECT 'o_totalprice' AS column_name, {rnd('avg(o_totalprice)')} AS mean,
       {rnd('stddev_samp(o_totalprice)')} AS std, {rnd('min(o_totalprice)')} AS min,
       {rnd('max(o_totalprice)')} AS max
FROM orders""")
def target_profile_continuous(spark, sf):
    kind, df = P.target_profile(read_table(spark, sf, "orders"), "o_totalprice")
    assert kind == "continuous"
    return round_doubles(df.withColumnRenamed("column", "column_name"))


# ---------------------------------------------------------------- histogram30
@register("histogram30", f"""
WITH mm AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders),
b AS (SELECT CAST(least(floor((o_totalprice - mn) / (mx - mn) * 30.0), 29) AS INTEGER) AS bin,
             count(*) AS count
      FROM orders, mm WHERE o_totalprice IS NOT NULL GROUP BY 1),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30))
SELECT bins.bin, {rnd('mn + bins.bin * ((mx - mn) / 30.0)')} AS bin_lo,
       {rnd('mn + (bins.bin + 1) * ((mx - mn) / 30.0)')} AS bin_hi,
       CAST(coalesce(b.count, 0) AS BIGINT) AS count
FROM bins CROSS JOIN mm LEFT JOIN b ON bins.bin = b.bin""")
def histogram30(spark, sf):
    return round_doubles(P.histogram(read_table(spark, sf, "orders"), "o_totalprice", 30))


# ---------------------------------------------------------------- null_patterns
@register("null_patterns", f"""
SELECT {', '.join(f'{q(col)} IS NULL AS {q(col + "_missing")}' for col in EVENTS_COLS)},
       count(*) AS n_rows
FROM {DIRTY_EVENTS_NORM_SQL} GROUP BY ALL""")
def null_patterns(spark, sf):
    return P.null_patterns(dirty_events(spark, sf))


@register("outlier_rows", """
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, user_id, event_type, value FROM events, b
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def outlier_rows(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return P.outlier_rows(ev, "value")


@register("label_balance", """
WITH v AS (SELECT 'quality' AS column_name, CAST(quality AS VARCHAR) AS value FROM labels WHERE quality IS NOT NULL
           UNION ALL
           SELECT 'toxic', CAST(toxic AS VARCHAR) FROM labels WHERE toxic IS NOT NULL),
c AS (SELECT column_name, value, count(*) AS count FROM v GROUP BY ALL),
s AS (SELECT column_name, count(*) AS n_classes, max(count) * 1.0 / min(count) > 3 AS is_imbalanced
      FROM c GROUP BY column_name)
SELECT column_name, value, count, n_classes, is_imbalanced FROM c JOIN s USING (column_name)""")
def label_balance(spark, sf):
    """Class distribution and imbalance flag of each label column of ``labels``."""
    labels = read_table(spark, sf, "labels")
    out = None
    for col in ["quality", "toxic"]:
        part = P.target_distribution(labels, col).select(F.lit(col).alias("column_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


WIDE = 34


def _wide_value(i: int) -> str:
    """A number of lineitem's keys and quantity, missing in every (7 + i)-th place or so."""
    return (f"CASE WHEN (l_orderkey + {i} * l_linenumber) % {7 + i} <> 0 "
            f"THEN CAST((l_partkey * {i + 1} + l_suppkey * {i}) % {101 + i} + l_quantity * {i % 3} AS DOUBLE) END")


_WIDE_PAIRS = [(i, j) for i in range(WIDE) for j in range(i + 1, WIDE)]


@register("correlations_wide_missing", f"""
WITH w AS (SELECT {", ".join(f"{_wide_value(i)} AS c{i}" for i in range(WIDE))} FROM lineitem),
a AS (SELECT {", ".join(f"corr(c{i}, c{j}) AS r{n}" for n, (i, j) in enumerate(_WIDE_PAIRS))} FROM w)
{union_all([f"SELECT CAST({n} AS INTEGER) AS pair, 'c{i}' AS feature1, 'c{j}' AS feature2, {rnd(f'r{n}')} AS correlation FROM a"
            for n, (i, j) in enumerate(_WIDE_PAIRS)])}""")
def correlations_wide_missing(spark, sf):
    """Correlations of 34 columns with missing values, on the rows where both are present."""
    li = read_table(spark, sf, "lineitem")
    wide = li.select(*[F.expr(_wide_value(i)).alias(f"c{i}") for i in range(WIDE)])
    return round_doubles(P.correlations(wide))
