"""Schema helpers: type classes and name rules (driver-side, no job)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def type_class(dt: T.DataType) -> str:
    """numeric / categorical / datetime / boolean / other (see SURVEY §1.2)."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType)):
        return "categorical"
    if isinstance(dt, DATETIME_TYPES):
        return "datetime"
    return "other"


def columns_of(df: DataFrame, kind: str, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if type_class(f.dataType) == kind and f.name not in exclude]


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return columns_of(df, "numeric", exclude)


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    return columns_of(df, "categorical", exclude)


def datetime_columns(df: DataFrame, exclude=()) -> list[str]:
    return columns_of(df, "datetime", exclude)


def c(name: str):
    """Column reference that tolerates dots and spaces in names."""
    return F.col(f"`{name}`")


def value_comparable(df: DataFrame, name: str):
    """Column cast to string for the long (column, value) frame; NULL stays NULL."""
    dt = df.schema[name].dataType
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return None
    return c(name).cast("string")


# Name rules for column roles.
TIME_NAMES = ["date", "datetime", "timestamp", "time", "ds", "dt", "year", "month", "day",
              "hour", "minute", "second", "created_at", "updated_at", "created", "updated"]
TEXT_NAMES = ["text", "content", "description", "comment", "review", "title", "body",
              "message", "sentence", "document", "question", "answer", "query", "passage"]
TARGET_NAMES = ["target", "label", "y", "class", "outcome", "result", "is_fraud", "is_spam",
                "is_positive", "is_negative", "survived", "price", "revenue", "sales", "rating"]
TEXT_COLUMN_PREFERENCE = ["text", "content", "description", "review", "comment", "title",
                          "body", "message", "sentence", "document"]
TEXT_LABEL_NAMES = ["label", "target", "class", "category", "sentiment"]
ID_NAMES = ["id", "Id", "ID", "index"]
TS_TIME_NAMES = ["date", "datetime", "timestamp", "time", "ds"]


def guess_target(columns: list[str]) -> str | None:
    """Target guess: known names in order, exact then case-insensitive, else last column."""
    if not columns:
        return None
    lower = {col.lower(): col for col in reversed(columns)}
    for name in TARGET_NAMES:
        if name in columns:
            return name
        if name.lower() in lower:
            return lower[name.lower()]
    return columns[-1]


def find_id_column(columns: list[str]) -> str | None:
    for name in ID_NAMES:
        if name in columns:
            return name
    return None


def normalise_name(col):
    """Case-folded name with '-' and ' ' turned into '_' (F14)."""
    return F.translate(F.lower(col), "- ", "__")
