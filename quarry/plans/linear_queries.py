"""Contract queries for exact split search and regularisation paths (model catalogue checks)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import linear_path as LP
from ..operators import stumps as ST
from ..sources.scan import read_table
from .common import rnd, round_doubles, round_sig_doubles, rsig, union_all
from .registry import register

STUMP_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
ALPHAS = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 1000000.0]


def _stump_sql(task: str, label: str, sums: list[str]) -> str:
    """Running sums over the distinct values of each feature; ``sums`` are the label's statistics."""
    stats = ", ".join(f"sum({e}) AS s{i}" for i, e in enumerate(sums))
    names = [f"s{i}" for i in range(len(sums))]
    run = ", ".join(f"sum({x}) OVER w AS l_{x}, sum({x}) OVER (PARTITION BY f) AS t_{x}" for x in ["n", *names])
    part = lambda a, n: "(" + " + ".join(f"power(CAST({a(x)} AS DOUBLE), 2)" for x in names) + f") / {n}"
    gain = (f"({part(lambda x: 'l_' + x, 'l_n')} + {part(lambda x: f'(t_{x} - l_{x})', '(t_n - l_n)')}"
            f" - {part(lambda x: 't_' + x, 't_n')}) / t_n")
    rows = union_all([f"SELECT {i} AS f, '{x}' AS feature, CAST({x} AS DOUBLE) AS v, label FROM d WHERE {x} IS NOT NULL"
                      for i, x in enumerate(STUMP_FEATURES)])
    return f"""SELECT '{task}' AS task, * FROM (
WITH d AS (SELECT *, {label} AS label FROM lineitem), r AS ({rows}),
g AS (SELECT f, feature, v, count(*) AS n, {stats} FROM r GROUP BY f, feature, v),
c AS (SELECT *, lead(v) OVER (PARTITION BY f ORDER BY v) AS nv, {run} FROM g WINDOW w AS (PARTITION BY f ORDER BY v)),
k AS (SELECT f, feature, (v + nv) / 2 AS threshold, {gain} AS gain, CAST(l_n AS BIGINT) AS n_left, CAST(t_n - l_n AS BIGINT) AS n_right, v
      FROM c WHERE nv IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY gain DESC, v) AS i FROM k)
SELECT feature, {rsig('threshold')} AS threshold, {rsig('gain', 6)} AS gain, n_left, n_right,
       CAST(row_number() OVER (ORDER BY gain DESC, f) AS INTEGER) AS rank FROM b WHERE i = 1)"""


@register("tree_stump", union_all([
    _stump_sql("regression", "CAST(l_extendedprice AS DOUBLE) - (SELECT avg(CAST(l_extendedprice AS DOUBLE)) FROM lineitem)", ["label"]),
    _stump_sql("classification", "l_returnflag", [f"CASE WHEN label = '{x}' THEN 1 ELSE 0 END" for x in "ANR"])]))
def tree_stump(spark, sf):
    """Exact best split of each lineitem feature for the price (variance) and the return flag (Gini)."""
    li = read_table(spark, sf, "lineitem")
    parts = []
    for task, label in ((ST.REGRESSION, "l_extendedprice"), (ST.CLASSIFICATION, "l_returnflag")):
        best = ST.best_splits(li, STUMP_FEATURES, label, task)
        exact = round_sig_doubles(best.select("feature", "threshold", "n_left", "n_right", "rank"))
        gain = round_sig_doubles(best.select("feature", "gain"), 6)
        parts.append(exact.join(gain, "feature").select(F.lit(task).alias("task"), "feature", "threshold", "gain", "n_left", "n_right", "rank"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _grid(alphas) -> str:
    return "(VALUES " + ", ".join(f"(CAST({a!r} AS DOUBLE))" for a in alphas) + ") AS grid(a)"


@register("enet_one_feature", f"""
WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) AS c, var_pop(l_quantity) AS v, avg(l_quantity) AS mx,
                  avg(l_extendedprice) AS my FROM lineitem),
b AS (SELECT a, sign(c) * greatest(abs(c) - a * 0.5, 0) / (v + a * 0.5) AS b, mx, my FROM s, {_grid(ALPHAS)})
SELECT a AS alpha, {rnd('b', 4)} AS coefficient, {rnd('my - b * mx', 3)} AS intercept FROM b""")
def enet_one_feature(spark, sf):
    """Elastic net (l1_ratio 0.5) of price on quantity along a path: the soft-threshold rule."""
    g = LP.gram(read_table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    out = LP.path_frame(spark, g, ALPHAS, 0.5)
    return round_doubles(out.select("alpha", F.round("coefficient", 4).alias("coefficient"), F.round("intercept", 3).alias("intercept")))


# Two features: of the nine sign patterns the one that meets the optimality conditions.
@register("lasso_path", f"""
WITH s AS (SELECT var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2, covar_pop(l_quantity, l_discount) AS v12,
                  covar_pop(l_quantity, l_extendedprice) AS c1, covar_pop(l_discount, l_extendedprice) AS c2,
                  avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM lineitem),
p AS (SELECT a, s1, s2, s.* FROM s, {_grid(ALPHAS)}, (VALUES (-1), (0), (1)) AS x(s1), (VALUES (-1), (0), (1)) AS y(s2)),
b AS (SELECT *, CASE WHEN s1 = 0 THEN 0 WHEN s2 = 0 THEN (c1 - a * s1) / v1
                     ELSE (v2 * (c1 - a * s1) - v12 * (c2 - a * s2)) / (v1 * v2 - v12 * v12) END AS b1,
                CASE WHEN s2 = 0 THEN 0 WHEN s1 = 0 THEN (c2 - a * s2) / v2
                     ELSE (v1 * (c2 - a * s2) - v12 * (c1 - a * s1)) / (v1 * v2 - v12 * v12) END AS b2 FROM p),
k AS (SELECT * FROM b WHERE sign(b1) = s1 AND sign(b2) = s2
      AND (s1 <> 0 OR abs(c1 - v12 * b2) <= a) AND (s2 <> 0 OR abs(c2 - v12 * b1) <= a)),
o AS (SELECT a AS alpha, 'l_quantity' AS feature, b1 AS b, my - b1 * m1 - b2 * m2 AS i, abs(s1) + abs(s2) AS z FROM k
      UNION ALL SELECT a, 'l_discount', b2, my - b1 * m1 - b2 * m2, abs(s1) + abs(s2) FROM k)
SELECT alpha, feature, {rnd('b', 3)} AS coefficient, {rnd('i', 2)} AS intercept, CAST(z AS INTEGER) AS n_nonzero FROM o""")
def lasso_path(spark, sf):
    """Lasso of price on quantity and discount along a path of alphas, from one Gram matrix."""
    g = LP.gram(read_table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    out = LP.path_frame(spark, g, ALPHAS)
    return round_doubles(out.select("alpha", "feature", "n_nonzero", F.round("coefficient", 3).alias("coefficient"),
                                    F.round("intercept", 2).alias("intercept")))
