"""Batch scoring of new data and output validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ID_NAMES, c


def with_synthetic_id(df: DataFrame, how: str = "index", out: str = "id") -> DataFrame:
    """Row ids when the data has none (P12): ``index`` = 0..n-1 in the order of
    all columns (distributed row index; identical rows are interchangeable), or
    ``hash`` = xxhash64 of the whole row (no sort, not dense)."""
    if how == "hash":
        return df.withColumn(out, F.xxhash64(*[c(x) for x in df.columns]))
    from .ordering import row_index
    return row_index(df, list(df.columns), out=out)


def score(model, df: DataFrame, target: str, id_col: str | None = None,
          label_names: list | None = None, synthetic_ids: str = "index",
          labels: DataFrame | None = None) -> DataFrame:
    """(id, <target>) for every row of ``df``.

    The id column is one of id / Id / ID / index when present, else synthetic
    (:func:`with_synthetic_id`). The id is carried through ``transform`` (J7),
    never re-attached by position. Class indexes become labels again by ``label_names`` (a short
    list) or ``labels`` (a table of value and code, joined; broadcast only under the size check).
    """
    id_col = id_col or next((n for n in ID_NAMES if n in df.columns), None)
    if id_col is None:
        df = with_synthetic_id(df, synthetic_ids)
        id_col = "id"
    pred = model.transform(df)
    p = F.col("prediction")
    if label_names is not None:
        p = F.element_at(F.array(*[F.lit(x) for x in label_names]), p.cast("int") + 1)
    if labels is not None:
        from .features import sized
        codes = sized(labels.select(F.col("value").alias("__label"), F.col("code").cast("bigint").alias("__code")))
        pred = pred.withColumn("__at", p.cast("bigint")).join(codes, F.col("__at") == F.col("__code"), "left")
        p = F.col("__label")
    return pred.select(c(id_col), p.alias(target))


def validate(sub: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, n_null_cells, is_valid, issues (V1).

    Rules: no missing value, at least one row, at least two columns.
    """
    ncols = len(sub.columns)
    nulls = sum((F.count_if(c(x).isNull()) for x in sub.columns), F.lit(0))
    agg = sub.agg(F.count(F.lit(1)).alias("n_rows"), nulls.cast("bigint").alias("n_null_cells"))
    issues = F.concat_ws(";",
                         F.when(F.col("n_null_cells") > 0, F.lit("missing values")),
                         F.when(F.col("n_rows") == 0, F.lit("no rows")),
                         F.when(F.lit(ncols) < 2, F.lit("fewer than 2 columns")))
    return agg.select("n_rows", F.lit(ncols).alias("n_columns"), "n_null_cells",
                      (issues == "").alias("is_valid"), issues.alias("issues"))


def write_submission(sub: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header (S9); one part file per task, as Spark writes it."""
    sub.write.mode(mode).option("header", True).csv(path)
