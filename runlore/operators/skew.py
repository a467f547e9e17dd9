"""Joins and lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 256
HOT_ROWS = 200_000


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE, min_rows: int = HOT_ROWS) -> list:
    """Keys with more than ``1/share`` of the rows and more than ``min_rows``; there can be no more than ``share``."""
    total = df.count()
    if total <= min_rows:
        return []
    counts = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNotNull())
    return [r[key] for r in counts.where(F.col("n") > max(min_rows, total // share)).select(key).collect()]


def join_hot(
    many: DataFrame, unique: DataFrame, key: str, how: str = "inner", share: int = HOT_SHARE, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Equi join of a side whose keys may be arbitrarily hot with a side that has one row per key.

    Rows of hot keys keep their place and meet a broadcast of at most ``share`` rows; the rest join as usual.
    """
    hot = hot_keys(many, key, share, min_rows)
    if not hot:
        return many.join(unique, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = many.where(~is_hot).join(unique.where(~is_hot), key, how)
    return cold.unionByName(many.where(is_hot).join(F.broadcast(unique.where(is_hot)), key, how))


def bounded_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint when the table has at most ``max_rows`` rows; otherwise the table as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
