"""Feature engineering as fit / transform over DataFrames.

Fitted state is split by size:
* per-column numbers (median, mean, population std, mode) - bounded by the
  number of columns, kept as Python dicts and applied as literals;
* per-category tables (label codes, target means) - they grow with the data,
  so they stay DataFrames and are joined back: broadcast only when the measured
  table size is under ``BROADCAST_BYTES``, else a shuffle join.

Fitted tables are materialised once with a reliable checkpoint (shared
checkpoint folder), so the size check and every later transform read the
stored table instead of recomputing the fit.

Transform is one projection plus one left join per categorical column.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import c, categorical_columns, numeric_columns
from ..sources.scan import normalise_missing
from ..session import cut_lineage
from .ordering import row_index
from .quantiles import quantiles

MISSING_TOKEN = "__MISSING__"  # fixed value: class name given to missing categories
BROADCAST_BYTES = 64 << 20     # code tables up to this many bytes of values are broadcast
STRATEGIES = ("basic", "advanced", "target_encoding", "custom")


# ---------------------------------------------------------------- fitted pieces
def fit_medians(df: DataFrame, cols) -> dict:
    """Exact median per numeric column (A35), via :func:`quantiles.quantiles`."""
    if not cols:
        return {}
    return {x: v[0] for x, v in quantiles(df, cols, [0.5]).items()}


def fit_numeric(df: DataFrame, cols) -> tuple[dict, dict]:
    """Medians and post-imputation mean / population std.

    Pass 1 counts missing values and, for columns
    without missing values (imputation changes nothing there), already gives
    mean and std. Then come the exact medians. A last pass runs only for
    columns with missing values, on the median-imputed values.
    """
    if not cols:
        return {}, {}
    aggs = []
    for i, x in enumerate(cols):
        v = c(x).cast("double")
        aggs += [F.count_if(v.isNull()).alias(f"m{i}"), F.avg(v).alias(f"a{i}"), F.stddev_pop(v).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    medians = fit_medians(df, cols)
    scaling = {x: (row[f"a{i}"], row[f"s{i}"]) for i, x in enumerate(cols) if row[f"m{i}"] == 0}
    with_missing = [x for i, x in enumerate(cols) if row[f"m{i}"] > 0]
    scaling.update(fit_scaling(df, with_missing, medians))
    return medians, scaling


def fit_scaling(df: DataFrame, cols, medians: dict) -> dict:
    """Mean and population std after median imputation, one aggregation."""
    if not cols:
        return {}
    aggs = []
    for i, x in enumerate(cols):
        v = F.coalesce(c(x).cast("double"), F.lit(medians.get(x)).cast("double"))
        aggs += [F.avg(v).alias(f"a{i}"), F.stddev_pop(v).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {x: (row[f"a{i}"], row[f"s{i}"]) for i, x in enumerate(cols)}


def value_counts_long(df: DataFrame, cols) -> DataFrame:
    """(column, value, count) of non-null values; one shuffle with partial counts."""
    exprs = [F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value")) for x in cols]
    long = df.select(F.explode(F.array(*exprs)).alias("kv")).select("kv.*")
    return (long.where(F.col("value").isNotNull()).groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("count")))


def fit_modes(df: DataFrame, cols) -> dict:
    """Most frequent value per column, smallest on ties.

    Top-1 per column from the long value-count frame; only one value per
    column reaches the driver.
    """
    if not cols:
        return {}
    vc = value_counts_long(df, cols)
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc())
    top = vc.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= 1).collect()
    out = {x: None for x in cols}
    out.update({r["column"]: r["value"] for r in top})
    return out


def fit_label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): sorted distinct values, with '__MISSING__' as a class when the
    column has missing values (E4). Codes come from a distributed row index."""
    v = F.coalesce(c(col).cast("string"), F.lit(MISSING_TOKEN))
    distinct = df.select(v.alias("value")).distinct()
    return row_index(distinct, ["value"], out="code")


def fit_category_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): sorted distinct non-null values (pandas category codes, E7)."""
    distinct = df.select(c(col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    return row_index(distinct, ["value"], out="code")


def fit_target_means(df: DataFrame, col: str, target: str) -> DataFrame:
    """(value, mean): mean target per category, missing categories dropped."""
    return (df.where(c(col).isNotNull())
            .groupBy(c(col).cast("string").alias("value"))
            .agg(F.avg(c(target).cast("double")).alias("mean")))


def sized(table: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Broadcast hint only when the table's measured size is small: the bytes of its
    string and binary values plus 16 for every other value, over all rows."""
    limit = BROADCAST_BYTES if max_bytes is None else max_bytes
    width = F.lit(16 * len(table.columns))
    for f in table.schema.fields:
        if f.dataType.simpleString() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(c(f.name)), F.lit(0))
    n = table.agg(F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(table) if n <= limit else table


FREQUENT_ROWS = 200_000  # rows of a dictionary that may be broadcast by their counts, whatever its size


def frequent_rows(table: DataFrame, count: str, total: int, most: int = FREQUENT_ROWS) -> DataFrame:
    """The rows of a dictionary whose ``count`` is above ``total / most``: at most ``most`` rows
    where ``total`` is the sum of the counts, and every value that many rows share."""
    return table.where(F.col(count) > F.lit(total / most))


def lookup(rows: DataFrame, table: DataFrame, keys: list, count: str, most: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with a dictionary of one row per value of the string columns ``keys``,
    in which ``count`` says how often a value occurs.

    A small dictionary is broadcast. Of a larger one the frequent values are, so that only rows of
    rare values are shuffled, and no value makes a partition much larger than others."""
    whole = sized(table)
    if whole is not table:
        return rows.join(whole, keys)
    total, most = table.agg(F.sum(count)).first()[0], most or FREQUENT_ROWS
    frequent = frequent_rows(table, count, total, most).withColumn("__known", F.lit(True))
    first = rows.join(F.broadcast(frequent), keys, "left")
    added = [x for x in table.columns if x not in keys]
    found = first.where("__known").drop("__known")
    rest = first.where("__known is null").drop("__known", *added)
    rare = table.where(~(F.col(count) > F.lit(total / most)))
    return found.unionByName(rest.join(rare, keys))


def join_code(df: DataFrame, key: F.Column, table: DataFrame, value_col: str, out: str,
              default) -> DataFrame:
    """Left join ``table(value, value_col)`` on ``key``; unmatched -> ``default``."""
    tmp = "__k_" + re.sub(r"\W", "_", out)
    t = sized(table.select(F.col("value").alias(tmp), F.col(value_col).alias("__v_" + tmp)))
    joined = df.withColumn(tmp, key).join(t, tmp, "left")
    return (joined.withColumn(out, F.coalesce(F.col("__v_" + tmp), F.lit(default)))
            .drop(tmp, "__v_" + tmp))


# ---------------------------------------------------------------- model
@dataclass
class FeatureModel:
    strategy: str
    numeric_cols: list
    categorical_cols: list
    medians: dict = field(default_factory=dict)
    scaling: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    code_tables: dict = field(default_factory=dict)      # col -> DataFrame(value, code)
    target_tables: dict = field(default_factory=dict)    # col -> DataFrame(value, mean)
    global_mean: float | None = None
    feature_names: list = field(default_factory=list)

    # ------------------------------------------------------------ transform
    def transform(self, df: DataFrame, keep=()) -> DataFrame:
        """Impute, scale, encode (and, for 'advanced', add interactions).

        ``keep`` lists input columns carried through unchanged (keys, target),
        which replaces the reference's positional re-attachment (J5, J7).
        """
        df = normalise_missing(df)
        out = df
        names = []
        for x in self.numeric_cols:
            med = self.medians.get(x)
            mean, std = self.scaling.get(x, (None, None))
            scale = std if std not in (None, 0.0) else 1.0
            v = F.coalesce(c(x).cast("double"), F.lit(med).cast("double"))
            out = out.withColumn("__f_" + x, (v - F.lit(mean)) / F.lit(scale))
            names.append(x)
        for x in self.categorical_cols:
            imputed = F.coalesce(c(x).cast("string"), F.lit(self.modes.get(x)).cast("string"))
            if self.strategy == "target_encoding":
                out = join_code(out, imputed, self.target_tables[x], "mean", "__f_" + x,
                                self.global_mean)
            else:
                out = join_code(out, imputed, self.code_tables[x], "code", "__f_" + x, -1)
                out = out.withColumn("__f_" + x, F.col("__f_" + x).cast("bigint"))
            names.append(x)
        cols = [F.col(f"`__f_{x}`").alias(x) for x in names]
        if self.strategy == "advanced" and len(self.numeric_cols) >= 2:
            for a, b in interaction_pairs(self.numeric_cols):
                cols.append((F.col(f"`__f_{a}`") * F.col(f"`__f_{b}`")).alias(f"{a}_{b}_mul"))
        result = out.select(*[c(k) for k in keep], *cols)
        self.feature_names = [n for n in result.columns if n not in keep]
        return result

    # ------------------------------------------------------------ persistence
    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Write the fitted state as Parquet parameter tables (restores fitted state)."""
        spark = None
        for t in list(self.code_tables.values()) + list(self.target_tables.values()):
            spark = t.sparkSession
        rows = []
        for x in self.numeric_cols:
            mean, std = self.scaling.get(x, (None, None))
            rows.append(("numeric", x, None, self.medians.get(x), mean, std))
        for x in self.categorical_cols:
            rows.append(("categorical", x, self.modes.get(x), None, None, None))
        rows.append(("meta", self.strategy, None, self.global_mean, None, None))
        if spark is None:
            from pyspark.sql import SparkSession
            spark = SparkSession.getActiveSession()
        spark.createDataFrame(
            rows, "kind string, name string, mode string, median double, mean double, std double"
        ).coalesce(1).write.mode(mode).parquet(f"{path}/columns")
        # One frame per kind of table, written with the given mode: saving twice replaces.
        schema = "value string, {} , column string"
        for tables, value, kind, folder in ((self.code_tables, "code", "code bigint", "codes"),
                                            (self.target_tables, "mean", "mean double", "target_means")):
            out = spark.createDataFrame([], schema.format(kind))
            for x, t in tables.items():
                out = out.unionByName(t.select("value", F.col(value).cast(kind.split()[1]).alias(value),
                                               F.lit(x).alias("column")))
            out.write.mode(mode).parquet(f"{path}/{folder}")

    @classmethod
    def load(cls, spark, path: str) -> "FeatureModel":
        rows = spark.read.parquet(f"{path}/columns").collect()
        meta = [r for r in rows if r["kind"] == "meta"][0]
        numeric = [r for r in rows if r["kind"] == "numeric"]
        cat = [r for r in rows if r["kind"] == "categorical"]
        m = cls(meta["name"], [r["name"] for r in numeric], [r["name"] for r in cat])
        m.medians = {r["name"]: r["median"] for r in numeric}
        m.scaling = {r["name"]: (r["mean"], r["std"]) for r in numeric}
        m.modes = {r["name"]: r["mode"] for r in cat}
        m.global_mean = meta["median"]
        # Both folders are always written (empty where the strategy has no such table).
        encoded = m.strategy == "target_encoding"
        for folder, tables, used in (("codes", m.code_tables, not encoded), ("target_means", m.target_tables, encoded)):
            stored = spark.read.parquet(f"{path}/{folder}")
            if used:
                tables.update({x: stored.where(F.col("column") == x).drop("column") for x in m.categorical_cols})
        return m


def interaction_pairs(numeric_cols):
    """Pairs (i in first 3, j in i+1 .. 3): up to 6 products of the first 4 columns."""
    pairs = []
    for i, a in enumerate(numeric_cols[:3]):
        for b in numeric_cols[i + 1:4]:
            pairs.append((a, b))
    return pairs


def fit(df: DataFrame, target: str | None = None, strategy: str = "basic",
        exclude=()) -> FeatureModel:
    """Fit on the feature columns of ``df`` (all but ``target`` and ``exclude``).

    Boolean, datetime and nested columns are not features (as in the reference).
    'custom' behaves as label encoding; 'target_encoding' needs a target.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")
    df = normalise_missing(df)
    skip = set(exclude) | ({target} if target else set())
    num = numeric_columns(df, skip)
    cat = categorical_columns(df, skip)
    m = FeatureModel(strategy, num, cat)
    m.medians, m.scaling = fit_numeric(df, num)
    m.modes = fit_modes(df, cat)
    if cat:
        if strategy == "target_encoding":
            if target is None:
                raise ValueError("target_encoding needs a target column")
            m.target_tables = {x: cut_lineage(fit_target_means(df, x, target)) for x in cat}
            m.global_mean = df.agg(F.avg(c(target).cast("double"))).first()[0]
        else:
            m.code_tables = {x: cut_lineage(fit_label_codes(df, x)) for x in cat}
    return m


def fit_transform(df: DataFrame, target: str | None = None, strategy: str = "basic",
                  keep=(), exclude=()) -> DataFrame:
    return fit(df, target, strategy, exclude).transform(df, keep)


# ---------------------------------------------------------------- category codes
def category_codes(df: DataFrame, cols=None, fitted: dict | None = None, keep=()) -> DataFrame:
    """Replace each categorical column by its sorted-category code; NULL -> -1.

    ``fitted`` (col -> code table) lets scoring reuse the training mapping;
    values unseen in training also get -1.
    """
    df = normalise_missing(df)
    cols = list(cols) if cols is not None else categorical_columns(df)
    fitted = fitted or {x: cut_lineage(fit_category_codes(df, x)) for x in cols}
    out = df
    for x in cols:
        out = join_code(out, c(x).cast("string"), fitted[x], "code", "__cc_" + x, -1)
        out = out.withColumn("__cc_" + x, F.col("__cc_" + x).cast("bigint"))
    others = [c(k) for k in df.columns if k not in cols]
    return out.select(*others, *[F.col(f"`__cc_{x}`").alias(x) for x in cols])


# ---------------------------------------------------------------- one-hot / polynomial
def _safe(s: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]+", "_", s)


def one_hot(df: DataFrame, cols=None, keep=(), max_categories: int | None = None) -> DataFrame:
    """0/1 indicator per category value (one column per value, so the list of values is a schema
    and reaches the driver).

    ``max_categories``, if given, makes a column with more values raise. Values whose column
    names would be equal (``a-b`` and ``a_b``) get numbered names, in the order of the values.
    """
    df = normalise_missing(df)
    cols = list(cols) if cols is not None else categorical_columns(df)
    if not cols:
        return df.select(*[c(k) for k in keep])
    vc = value_counts_long(df, cols)
    if max_categories is not None:
        sizes = {r["column"]: r["n"] for r in vc.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        too_big = [x for x, n in sizes.items() if n > max_categories]
        if too_big:
            raise ValueError(f"columns {too_big} have more than {max_categories} categories")
    values = {}
    for r in vc.select("column", "value").collect():
        values.setdefault(r["column"], []).append(r["value"])
    out, used = [c(k) for k in keep], {k.lower() for k in keep}
    for x in cols:
        for v in sorted(values.get(x, [])):
            name, n = f"{x}_{_safe(v)}", 1
            while name.lower() in used:
                n += 1
                name = f"{x}_{_safe(v)}_{n}"
            used.add(name.lower())
            out.append(F.when(c(x).cast("string") == F.lit(v), 1).otherwise(0).alias(name))
    return df.select(*out)


@dataclass
class OneHotDictionary:
    """(column, value, index, count) of every category value, sorted; ``size`` values in all."""
    table: DataFrame
    cols: list
    size: int


def fit_one_hot(df: DataFrame, cols=None) -> OneHotDictionary:
    """Number the values of all category columns, by column (in the given order) and value. The
    table stays a frame, so a column may have more values than a schema could have columns."""
    df = normalise_missing(df)
    cols = list(cols) if cols is not None else categorical_columns(df)
    place = F.create_map(*[x for i, n in enumerate(cols) for x in (F.lit(n), F.lit(i))]) if cols else F.lit(None)
    values = value_counts_long(df, cols).withColumn("__place", place[F.col("column")]) if cols else \
        df.sparkSession.createDataFrame([], "column string, value string, count bigint, __place int")
    table = cut_lineage(row_index(values, ["__place", "value"], out="index").select("column", "value", "index", "count"))
    return OneHotDictionary(table, cols, table.count())


def one_hot_entries(df: DataFrame, key_cols, fitted: OneHotDictionary) -> DataFrame:
    """(key columns, index, value): the ones of the one-hot matrix, one row per row and column.

    Missing values and values that the dictionary does not hold have no entry (their row of the
    matrix is all zero there). One lookup in the dictionary for all columns, see :func:`lookup`."""
    df = normalise_missing(df)
    pairs = F.array(*[F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value")) for x in fitted.cols])
    pairs = pairs.cast("array<struct<column: string, value: string>>")  # also where there is no column
    long = df.select(*[c(k) for k in key_cols], F.explode(pairs).alias("__p")).select(*[c(k) for k in key_cols], "__p.column", "__p.value")
    hit = lookup(long.where(F.col("value").isNotNull()), fitted.table, ["column", "value"], "count")
    return hit.select(*[c(k) for k in key_cols], "index", F.lit(1.0).alias("value"))


def one_hot_vectors(df: DataFrame, key: str, fitted: OneHotDictionary, out: str = "features") -> DataFrame:
    """(key, sparse vector) for models: entries gathered by a unique key, at most one per column."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    size = fitted.size
    made = F.udf(lambda at: SparseVector(size, at or [], [1.0] * len(at or [])), VectorUDT())
    lists = one_hot_entries(df, [key], fitted).groupBy(c(key).alias("__key")).agg(F.sort_array(F.collect_list("index")).alias("__at"))
    joined = df.select(c(key)).join(lists, c(key) == F.col("__key"), "left")
    return joined.select(c(key), made(F.col("__at").cast("array<int>")).alias(out))


def polynomial(df: DataFrame, cols, degree: int = 2, keep=()) -> DataFrame:
    """All monomials of the columns up to ``degree`` (degree 1 included) as projections."""
    if not 1 <= degree <= 3:
        raise ValueError("degree must be 1, 2 or 3")
    df = normalise_missing(df)
    out = [c(k) for k in keep]
    for d in range(1, degree + 1):
        for combo in itertools.combinations_with_replacement(cols, d):
            expr = None
            for x in combo:
                term = c(x).cast("double")
                expr = term if expr is None else expr * term
            name = combo[0] if d == 1 else "_x_".join(combo)
            out.append(expr.alias(name if d > 1 else combo[0]))
    return df.select(*out)
