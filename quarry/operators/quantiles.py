"""Exact quantiles (linear interpolation, as ``percentile`` / DuckDB ``quantile_cont``).

One path for all columns and sizes. Spark's exact ``percentile`` keeps a value -> count
map per group and merges every map in one task, which a continuous column fills at scale.
Instead each wanted rank (two per column and probability) has a bracket of values that holds it:

* first scan: counts (and moments, if asked for), and brackets from ``percentile_approx`` a little
  below and above the rank;
* next scan: for all brackets at once, how many values lie below and how many inside;
* brackets that hold at most ``INSIDE`` values give them, counted, to a grouped sort bounded by
  that number. Only brackets that hold more are cut, by ``percentile_approx`` inside, in a scan of
  their own, and narrowed to a part of about 3 / 64. A bracket of one hot value is that value. A
  column that is not done after ``ROUNDS`` rounds (values that crowd at a bracket's ends) takes the
  distributed selection below.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c
from .ordering import IDX, prefix_sums, row_index

ACCURACY = 2000      # of percentile_approx: brackets of about 1 / 1000 of the values
ROUNDS = 5           # scans before a column that resists goes through the distributed selection
INSIDE = 20_000      # values of a bracket that are listed


def _interpolate(values_at: dict, n: int, p: float):
    pos = p * (n - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    a, b = values_at[lo], values_at[hi]
    return a + (b - a) * (pos - lo)


def select_quantiles(df: DataFrame, col: str, probs) -> list:
    """Exact quantiles of one column by distributed selection (no value map)."""
    x = c(col).cast("double")
    vc = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    n = vc.agg(F.sum("cnt")).first()[0]
    if not n:
        return [None for _ in probs]
    ranks = sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    cum = prefix_sums(row_index(vc, ["v"]), IDX, ["cnt"])
    start = F.col("cnt_cum") - F.col("cnt")
    hit = None
    for r in ranks:
        cond = (start <= F.lit(r)) & (F.col("cnt_cum") > F.lit(r))
        hit = cond if hit is None else hit | cond
    rows = cum.where(hit).select("v", "cnt_cum", "cnt").collect()
    values_at = {}
    for r in ranks:
        for row in rows:
            if row["cnt_cum"] - row["cnt"] <= r < row["cnt_cum"]:
                values_at[r] = row["v"]
    return [_interpolate(values_at, n, p) for p in probs]


def bracket_quantiles(df: DataFrame, cols, probs, inside: int = INSIDE, accuracy: int = ACCURACY,
                      moments: dict | None = None) -> dict:
    """{column: [quantile per prob]}, exact, by narrowing brackets (all columns in each scan).

    ``moments`` is filled with column: (count, mean, std (n-1), min, max), from the first scan."""
    slack = 2.0 / accuracy
    wide = df.select(*[c(x).cast("double").alias(f"v{i}") for i, x in enumerate(cols)])
    steps = [min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)]
    first = wide.agg(*[e for i in range(len(cols)) for e in (
        F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}"),
        F.percentile_approx(f"v{i}", steps, accuracy).alias(f"q{i}"),
        *([F.avg(f"v{i}").alias(f"mean{i}"), F.stddev_samp(f"v{i}").alias(f"std{i}")] if moments is not None else []))]).first()
    ns = {i: first[f"n{i}"] for i in range(len(cols))}
    if moments is not None:
        moments.update({x: tuple(first[f"{m}{i}"] for m in ("n", "mean", "std", "lo", "hi")) for i, x in enumerate(cols)})
    found: dict = {}  # (column, rank) -> value
    # (column, lo, hi, LO, HI) -> ranks wanted: looked for in lo .. hi, known to be in LO .. HI
    todo: dict = {}
    for i in range(len(cols)):
        for j, p in enumerate(probs):
            if not ns[i]:
                continue
            pos = p * (ns[i] - 1)
            q, low, high = first[f"q{i}"], first[f"lo{i}"], first[f"hi{i}"]
            # The ends of the column where the bracket may reach past them.
            lo = low if p - slack <= slack else q[2 * j]
            hi = high if p + slack >= 1 - slack else q[2 * j + 1]
            todo.setdefault((i, lo, hi, low, high), set()).update((math.floor(pos), math.ceil(pos)))
    for _ in range(ROUNDS):
        if not todo:
            break
        brackets = list(todo)
        scan = wide.agg(*[e for b, (i, lo, hi, _, _) in enumerate(brackets) for e in _bracket_counts(b, i, lo, hi)]).first()
        full = [(b, i, lo, hi) for b, (i, lo, hi, _, _) in enumerate(brackets) if scan[f"held{b}"] > inside and lo != hi]
        cuts = [k / 64 for k in range(65)]
        inner = wide.agg(*[F.percentile_approx(F.when(F.col(f"v{i}").between(lo, hi), F.col(f"v{i}")), cuts, accuracy).alias(f"cuts{b}")
                           for b, i, lo, hi in full]).first() if full else None
        listed, after = [], {}
        for b, (i, lo, hi, low, high) in enumerate(brackets):
            below, held = scan[f"below{b}"], scan[f"held{b}"]
            for r in todo[brackets[b]]:
                if r < below:  # the approximate bracket missed the rank: it is in what is left of the known one
                    after.setdefault((i, low, lo, low, lo), set()).add(r)
                elif r >= below + held:
                    after.setdefault((i, hi, high, hi, high), set()).add(r)
                elif lo == hi:
                    found[i, r] = lo
                elif held <= inside:
                    listed.append((b, i, lo, hi, below, r))
                else:
                    after.setdefault((i, *_narrower(lo, hi, inner[f"cuts{b}"], (r - below) / (held - 1)), lo, hi), set()).add(r)
        if listed:
            spans = {b: (i, lo, hi) for b, i, lo, hi, _, _ in listed}
            kept = [F.when(F.col(f"v{i}").between(lo, hi), F.struct(F.lit(b).alias("b"), F.col(f"v{i}").alias("v")))
                    for b, (i, lo, hi) in spans.items()]
            any_ = None
            for i, lo, hi in spans.values():
                one = F.col(f"v{i}").between(lo, hi)
                any_ = one if any_ is None else any_ | one
            values = (wide.where(any_).select(F.explode(F.array(*kept)).alias("x")).where("x is not null")
                      .groupBy("x.b", "x.v").agg(F.count(F.lit(1)).alias("n"))
                      .groupBy("b").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("vs")))
            # The values at the wanted ranks leave each bracket's list, not the list.
            wanted = {}
            for b, i, lo, hi, below, r in listed:
                wanted.setdefault(b, []).append((i, r, r - below))
            ranks = F.create_map(*[x for b, w in wanted.items() for x in (F.lit(b), F.array(*[F.lit(k).cast("bigint") for _, _, k in w]))])
            def at_rank(rank):
                step = lambda a, x: F.struct((a["left"] - x["n"]).alias("left"),
                                             F.when((a["left"] >= 0) & (a["left"] < x["n"]), x["v"]).otherwise(a["v"]).alias("v"))
                return F.aggregate("vs", F.struct(rank.alias("left"), F.lit(None).cast("double").alias("v")), step, lambda a: a["v"])
            for row in values.select("b", F.transform(ranks[F.col("b")], at_rank).alias("v")).collect():
                for (i, r, _), v in zip(wanted[row["b"]], row["v"], strict=True):
                    found[i, r] = v
        todo = after
    out = {}
    left = {i for i, *_ in todo}  # columns whose brackets would not narrow
    for i, x in enumerate(cols):
        if i in left:
            out[x] = select_quantiles(df, x, probs)
            continue
        out[x] = [_interpolate({r: found[i, r] for r in (math.floor(p * (ns[i] - 1)), math.ceil(p * (ns[i] - 1)))}, ns[i], p)
                  if ns[i] else None for p in probs]
    return out


def _bracket_counts(b: int, i: int, lo, hi) -> list:
    v = F.col(f"v{i}")
    return [F.count_if(v < lo).alias(f"below{b}"), F.count_if(v.between(lo, hi)).alias(f"held{b}")]


def _narrower(lo, hi, cuts, at: float) -> tuple:
    """A part of lo .. hi that should hold the value at this share of the ranks: a few cuts wide,
    or else one side of a value between."""
    step = max(0, min(len(cuts) - 2, int(at * (len(cuts) - 1))))
    near = cuts[max(step - 1, 0)], cuts[min(step + 2, len(cuts) - 1)]
    if near != (lo, hi):
        return near
    inner = [x for x in cuts if lo < x < hi]
    middle = inner[len(inner) // 2] if inner else (lo if at < 0.5 else hi)
    return (lo, middle) if at < 0.5 else (middle, hi)


def quantiles(df: DataFrame, cols, probs, method: str = "brackets") -> dict:
    """{column: [quantile per prob]} exact; ``method`` brackets (the default for every size) /
    select (one column at a time by a range-partitioned index) / approx."""
    cols, probs = list(cols), list(probs)
    if not cols:
        return {}
    if method == "approx":
        row = df.agg(*[F.percentile_approx(c(x).cast("double"), probs, 10000).alias(f"q{i}")
                       for i, x in enumerate(cols)]).first()
        return {x: list(row[f"q{i}"] or [None] * len(probs)) for i, x in enumerate(cols)}
    if method == "select":
        return {x: select_quantiles(df, x, probs) for x in cols}
    if method != "brackets":
        raise ValueError(method)
    return bracket_quantiles(df, cols, probs)
