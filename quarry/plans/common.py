"""Small helpers shared by the contract queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column for presentation (D6: operators stay unrounded).

    ``+ 0.0`` turns a negative zero into zero, as in :func:`rnd`.
    """
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append((F.round(F.col(f"`{f.name}`").cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def rnd(expr: str, digits: int = DIGITS) -> str:
    """DuckDB counterpart of :func:`round_doubles` for one expression."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


SIG = 10


def round_sig_col(x, digits: int = SIG):
    """Round to ``digits`` significant digits with operations both engines
    evaluate identically: k = digits - 1 - floor(log10|x|); round(x * 10^k) / 10^k
    (or round(x / 10^-k) * 10^-k); integer powers of ten are exact doubles."""
    k = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    pos = F.round(x * F.pow(F.lit(10.0), k)) / F.pow(F.lit(10.0), k)
    neg = F.round(x / F.pow(F.lit(10.0), -k)) * F.pow(F.lit(10.0), -k)
    r = F.when(k >= 0, pos).otherwise(neg)
    return F.when(x.isNull() | (x == 0) | F.isnan(x) | (k > 300) | (k < -300), x).otherwise(r) + F.lit(0.0)


def round_sig_doubles(df: DataFrame, digits: int = SIG) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round_sig_col(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def rsig(expr: str, digits: int = SIG) -> str:
    """DuckDB counterpart of :func:`round_sig_col`."""
    x = f"CAST({expr} AS DOUBLE)"
    k = f"({digits - 1} - floor(log10(abs({x}))))"
    return (f"(CASE WHEN {x} IS NULL OR {x} = 0 OR isnan({x}) OR {k} > 300 OR {k} < -300 THEN {x} "
            f"WHEN {k} >= 0 THEN round({x} * pow(10.0, {k})) / pow(10.0, {k}) "
            f"ELSE round({x} / pow(10.0, -{k})) * pow(10.0, -{k}) END + 0.0)")


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def q(name: str) -> str:
    """Quote an identifier for DuckDB."""
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    """Quote a string literal for DuckDB."""
    return "'" + s.replace("'", "''") + "'"
