"""Deterministic row hashing for splits and sampling (decision D4).

``rand``/``randomSplit`` depend on partitioning; an md5 of ``seed:key`` does
not, and DuckDB computes the same number:
``('0x' || substr(md5(seed || ':' || key), 1, 8))::BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(key: Column, seed: int = 42) -> Column:
    """First 32 bits of md5('seed:key') as a non-negative bigint."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def key_hash_sql(key_sql: str, seed: int = 42) -> str:
    """The DuckDB expression equal to :func:`key_hash`."""
    return f"('0x' || substr(md5('{seed}:' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT"
