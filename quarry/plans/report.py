"""EDA report frame (V12) and routing by modality (the reference's run_eda).

``eda_report`` returns one long frame (section, subject, metric, value) built
from the operators' small result frames - the data behind the reference's
Markdown report. Each section is its own aggregation job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..operators import profile as P
from ..operators import rules as R
from ..operators import series as S
from ..operators import text as X
from ..sources import scan as SC

SCHEMA = "section string, subject string, metric string, value string"


def to_long(df: DataFrame, section: str, subject: str | None = None) -> DataFrame:
    """Every non-subject column becomes a (metric, value) row."""
    metrics = [c for c in df.columns if c != subject]
    subj = F.col(subject).cast("string") if subject else F.lit(None).cast("string")
    structs = [F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("string").alias("value"))
               for m in metrics]
    return df.select(F.lit(section).alias("section"), subj.alias("subject"),
                     F.explode(F.array(*structs)).alias("kv")).select("section", "subject", "kv.metric", "kv.value")


def _union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


def tabular_report(df: DataFrame, target: str | None = None) -> DataFrame:
    target = target or df.columns[-1]
    found = R.Findings(df, target)  # what several sections use is computed once
    kind, tprof = found.target_profile
    parts = [
        to_long(df.agg(F.count(F.lit(1)).alias("n_samples")).withColumn("n_features", F.lit(len(df.columns))),
                "basic_stats"),
        to_long(P.missing_report(df), "missing", "column"),
        to_long(P.duplicate_counts(df), "duplicates"),
        to_long(P.describe(df).drop("ordinal"), "numeric", "column"),
        to_long(P.top_correlations(df).withColumn(
            "pair", F.concat_ws("~", "feature1", "feature2")).drop("feature1", "feature2"),
            "correlations", "pair"),
        to_long(P.categorical_summary(df, hashed_cols="auto").withColumn(
            "subject", F.concat_ws("=", "column", "value")).drop("column", "value"), "categorical", "subject"),
        to_long(found.outliers, "outliers", "column"),
        to_long(tprof, f"target_{kind}", "value" if kind == "categorical" else "column"),
        to_long(R.eda_flags(df, target, found), "recommendations", "code"),
    ]
    return _union(parts)


def timeseries_report(df: DataFrame, ts: str | None = None, value: str | None = None) -> DataFrame:
    ts = ts or S.detect_time_column(df)
    series = S.as_series(df, ts, value)
    st = S.stationarity(series)
    parts = [to_long(S.date_range(df, ts), "date_range", "time_column"),
             to_long(S.frequency(df, ts), "frequency"),
             to_long(P.missing_report(df), "missing", "column"),
             to_long(S.value_stats(series), "value_stats"),
             to_long(S.trend(series), "trend"),
             to_long(st, "stationarity")]
    flags = R.series_flags(st.first())
    if flags:
        parts.append(to_long(df.sparkSession.createDataFrame(flags, "code string, detail string"),
                             "recommendations", "code"))
    return _union(parts)


def text_report(df: DataFrame, text_col: str | None = None) -> DataFrame:
    text_col = text_col or X.detect_text_column(df)
    label = X.detect_label_column(df, text_col)
    parts = [to_long(X.text_lengths(df, text_col), "length_stats"),
             to_long(X.vocabulary(df, text_col), "vocabulary"),
             to_long(X.top_words(df, text_col, 20), "top_words", "word"),
             to_long(X.top_words_without_stop_words(df, text_col), "top_words_filtered", "word"),
             to_long(X.empty_texts(df, text_col), "empty_texts")]
    if label:
        parts.append(to_long(X.label_distribution(df, label), "target_distribution", "label"))
    return _union(parts)


def eda_report(df: DataFrame, modality: str | None = None, target: str | None = None) -> DataFrame:
    """Route to the modality's report (tabular / timeseries / nlp)."""
    modality = modality or R.detect_modality(df)
    if modality == "timeseries":
        return timeseries_report(df)
    if modality == "nlp":
        return text_report(df)
    return tabular_report(df, target)


def image_report(spark, root: str) -> DataFrame:
    from ..operators import images as IM
    from ..sources.images import image_inventory
    inv = image_inventory(spark, root)
    return _union([to_long(IM.class_counts(inv), "class_distribution", "class"),
                   to_long(IM.image_stats(inv), "image_stats")])


def load_path(spark, path: str) -> tuple[str, DataFrame | None]:
    """(modality, table) of a file or folder; a folder of images has no table."""
    modality = SC.path_modality(spark, path)
    if modality == "vision":
        return modality, None
    suffix = SC.path_suffix(path)
    if not suffix and modality == "nlp":
        return modality, SC.read_text_files(spark, path)
    df = SC.read_path(spark, path)
    if suffix in (".json", ".jsonl"):  # a text file by name, but its columns say what it holds
        modality = R.detect_modality(df)
    return (modality if modality == "nlp" else R.detect_modality(df)), df


def report_path(spark, path: str, target: str | None = None) -> DataFrame:
    """The report of whatever lies under ``path``: images, texts, a series or a table."""
    modality, df = load_path(spark, path)
    return image_report(spark, path) if df is None else eda_report(df, modality, target)


def strategy_path(spark, path: str, target: str | None = None) -> DataFrame:
    """Summary, quality, risks and steps of a table under ``path``."""
    _, df = load_path(spark, path)
    if df is None:
        raise ValueError(f"{path} holds images, not a table")
    return strategy_report(df, target)


def strategy_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """Detect -> summarise -> quality -> risks and preprocessing steps, as one long
    frame (the reference's planning entry point, without its fixed model lists)."""
    found = R.Findings(df, target)
    spark = df.sparkSession
    row = lambda x: spark.createDataFrame([x], StructType([
        StructField(n, {int: LongType(), float: DoubleType()}.get(type(v), StringType())) for n, v in x.asDict().items()]))
    return _union([to_long(row(found.summary), "summary"), to_long(row(found.quality), "quality"),
                   to_long(R.risks(df, target, found), "risks", "code"),
                   to_long(R.preprocessing_steps(df, target, found), "preprocessing", "code")])
