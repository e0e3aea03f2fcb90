"""Contract queries for feature fit / transform."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..sources.scan import DIRTY_EVENTS_NORM_SQL, dirty_events, read_table
from .common import lit, q, rnd, round_doubles
from .registry import register

EV_NUM = ["event_id", "user_id", "value"]
EV_CAT = ["event_type", "props"]
LI_FIRST4 = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LI_POLY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _keyed_events(spark, sf):
    return dirty_events(spark, sf).withColumn("key", F.col("event_id"))


def _scale_sql(src: str, cols: list[str]) -> tuple[str, dict]:
    """CTEs med / sc and the scaled expression per column."""
    med = ", ".join(f"median(CAST({q(x)} AS DOUBLE)) AS {q('m_' + x)}" for x in cols)
    sc = ", ".join(
        f"avg(coalesce(CAST({q(x)} AS DOUBLE), {q('m_' + x)})) AS {q('a_' + x)}, "
        f"stddev_pop(coalesce(CAST({q(x)} AS DOUBLE), {q('m_' + x)})) AS {q('s_' + x)}"
        for x in cols)
    ctes = f"med AS (SELECT {med} FROM {src}), sc AS (SELECT {sc} FROM {src}, med)"
    exprs = {x: (f"(coalesce(CAST(d.{q(x)} AS DOUBLE), {q('m_' + x)}) - {q('a_' + x)}) / "
                 f"CASE WHEN {q('s_' + x)} IS NULL OR {q('s_' + x)} = 0 THEN 1 ELSE {q('s_' + x)} END")
             for x in cols}
    return ctes, exprs


def _impute_scale_sql():
    ctes, ex = _scale_sql("d", EV_NUM)
    return f"""
WITH d AS (SELECT * FROM {DIRTY_EVENTS_NORM_SQL}), {ctes}
SELECT d.event_id AS key, {', '.join(f"{rnd(ex[x])} AS {q(x)}" for x in EV_NUM)}
FROM d, med, sc"""


@register("feat_impute_scale", _impute_scale_sql())
def feat_impute_scale(spark, sf):
    df = _keyed_events(spark, sf)
    # Only the numeric part is reported, so only it is fitted.
    model = FE.fit(df, strategy="basic", exclude=("key", *EV_CAT))
    return round_doubles(model.transform(df, keep=("key",)).select("key", *EV_NUM))


def _mode_cte(src, x):
    return (f"{q('mode_' + x)} AS (SELECT CAST({q(x)} AS VARCHAR) AS m FROM {src} "
            f"WHERE {q(x)} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")


def _label_codes_sql():
    ctes = []
    for x in EV_CAT:
        ctes.append(f"{q('cls_' + x)} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM "
                    f"(SELECT DISTINCT coalesce(CAST({q(x)} AS VARCHAR), '__MISSING__') AS v FROM d))")
        ctes.append(_mode_cte("d", x))
    joins = "\n".join(
        f"LEFT JOIN {q('mode_' + x)} ON TRUE "
        f"LEFT JOIN {q('cls_' + x)} ON coalesce(CAST(d.{q(x)} AS VARCHAR), {q('mode_' + x)}.m) = {q('cls_' + x)}.v"
        for x in EV_CAT)
    sel = ", ".join(f"CAST(coalesce({q('cls_' + x)}.code, -1) AS BIGINT) AS {q(x)}" for x in EV_CAT)
    return f"""
WITH d AS (SELECT * FROM {DIRTY_EVENTS_NORM_SQL}), {', '.join(ctes)}
SELECT d.event_id AS key, {sel} FROM d {joins}"""


@register("feat_label_codes", _label_codes_sql())
def feat_label_codes(spark, sf):
    df = _keyed_events(spark, sf)
    model = FE.fit(df, strategy="basic", exclude=("key", *EV_NUM))
    return model.transform(df, keep=("key",)).select("key", *EV_CAT)


def _target_encode_sql():
    ctes = []
    for x in EV_CAT:
        ctes.append(f"{q('te_' + x)} AS (SELECT CAST({q(x)} AS VARCHAR) AS v, avg(value) AS mean "
                    f"FROM d WHERE {q(x)} IS NOT NULL GROUP BY 1)")
        ctes.append(_mode_cte("d", x))
    ctes.append("g AS (SELECT avg(value) AS gm FROM d)")
    joins = "\n".join(
        f"LEFT JOIN {q('mode_' + x)} ON TRUE "
        f"LEFT JOIN {q('te_' + x)} ON coalesce(CAST(d.{q(x)} AS VARCHAR), {q('mode_' + x)}.m) = {q('te_' + x)}.v"
        for x in EV_CAT)
    sel = ", ".join(rnd(f"coalesce({q('te_' + x)}.mean, g.gm)") + f" AS {q(x)}" for x in EV_CAT)
    return f"""
WITH d AS (SELECT * FROM {DIRTY_EVENTS_NORM_SQL}), {', '.join(ctes)}
SELECT d.event_id AS key, {sel} FROM d CROSS JOIN g {joins}"""


@register("feat_target_encode", _target_encode_sql())
def feat_target_encode(spark, sf):
    df = _keyed_events(spark, sf)
    model = FE.fit(df, target="value", strategy="target_encoding", exclude=("key", "event_id", "user_id"))
    return round_doubles(model.transform(df, keep=("key",)).select("key", *EV_CAT))


def _interactions_sql():
    ctes, ex = _scale_sql("lineitem", LI_FIRST4)
    prods = [f"{rnd(f'({ex[a]}) * ({ex[b]})')} AS {q(a + '_' + b + '_mul')}"
             for a, b in FE.interaction_pairs(LI_FIRST4)]
    return f"""
WITH {ctes}
SELECT d.l_orderkey AS key, {', '.join(prods)} FROM lineitem d, med, sc"""


@register("feat_interactions", _interactions_sql())
def feat_interactions(spark, sf):
    li = read_table(spark, sf, "lineitem").withColumn("key", F.col("l_orderkey"))
    li = li.select("key", *LI_FIRST4, "l_shipdate")  # last column is the target, as in the reference
    model = FE.fit(li, target="l_shipdate", strategy="advanced", exclude=("key",))
    names = [f"{a}_{b}_mul" for a, b in FE.interaction_pairs(LI_FIRST4)]
    return round_doubles(model.transform(li, keep=("key",)).select("key", *names))


def _category_codes_sql():
    ctes = [f"{q('cc_' + x)} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM "
            f"(SELECT DISTINCT CAST({q(x)} AS VARCHAR) AS v FROM d WHERE {q(x)} IS NOT NULL))"
            for x in EV_CAT]
    joins = "\n".join(f"LEFT JOIN {q('cc_' + x)} ON CAST(d.{q(x)} AS VARCHAR) = {q('cc_' + x)}.v"
                      for x in EV_CAT)
    sel = ", ".join(f"CAST(coalesce({q('cc_' + x)}.code, -1) AS BIGINT) AS {q(x)}" for x in EV_CAT)
    return f"""
WITH d AS (SELECT * FROM {DIRTY_EVENTS_NORM_SQL}), {', '.join(ctes)}
SELECT d.event_id AS key, {sel} FROM d {joins}"""


@register("feat_category_codes", _category_codes_sql())
def feat_category_codes(spark, sf):
    df = _keyed_events(spark, sf)
    return FE.category_codes(df, EV_CAT).select("key", *EV_CAT)


# Fixed values for the oracle only: the category values present in orders.
ONE_HOT_VALUES = {"o_orderstatus": ["F", "O", "P"],
                  "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}


def _one_hot_sql():
    sel = []
    for x, vals in ONE_HOT_VALUES.items():
        for v in vals:
            sel.append(f"CASE WHEN {q(x)} = {lit(v)} THEN 1 ELSE 0 END AS {q(x + '_' + FE._safe(v))}")
    return f"SELECT o_orderkey, {', '.join(sel)} FROM orders"


@register("feat_one_hot", _one_hot_sql())
def feat_one_hot(spark, sf):
    orders = read_table(spark, sf, "orders")
    return FE.one_hot(orders, list(ONE_HOT_VALUES), keep=("o_orderkey",))


def _poly_sql():
    import itertools
    sel = []
    for d in (1, 2):
        for combo in itertools.combinations_with_replacement(LI_POLY, d):
            expr = " * ".join(f"CAST({q(x)} AS DOUBLE)" for x in combo)
            sel.append(f"{expr} AS {q('_x_'.join(combo))}")
    return f"SELECT l_orderkey, l_linenumber, {', '.join(sel)} FROM lineitem"


@register("feat_polynomial", _poly_sql())
def feat_polynomial(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return FE.polynomial(li, LI_POLY, 2, keep=("l_orderkey", "l_linenumber"))


LI_CAT = ["l_returnflag", "l_linestatus"]
_ONE_HOT_ROWS = "\nUNION ALL\n".join(
    f"SELECT l_orderkey, l_linenumber, {i} AS place, CAST({x} AS VARCHAR) AS v FROM lineitem WHERE {x} IS NOT NULL"
    for i, x in enumerate([*LI_CAT, "l_partkey", "l_quantity"]))


@register("feat_one_hot_sparse", f"""
WITH r AS ({_ONE_HOT_ROWS}),
k AS (SELECT place, v, row_number() OVER (ORDER BY place, v) - 1 AS index FROM (SELECT DISTINCT place, v FROM r))
SELECT l_orderkey, l_linenumber, index, CAST(1 AS DOUBLE) AS value FROM r JOIN k USING (place, v)""")
def feat_one_hot_sparse(spark, sf):
    """Entries of the sparse one-hot matrix of lineitem, a column of which has thousands of values."""
    li = read_table(spark, sf, "lineitem")
    fitted = FE.fit_one_hot(li, [*LI_CAT, "l_partkey", "l_quantity"])
    return FE.one_hot_entries(li, ["l_orderkey", "l_linenumber"], fitted)
