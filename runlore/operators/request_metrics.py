"""Counters and cumulative histograms over a run log (run_id, ts, status, latency_s, retrieved)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The upper bounds of the buckets.
LATENCY_BOUNDS = (0.5, 1.0, 2.0, 3.0, 5.0, 10.0, 30.0)
RETRIEVED_BOUNDS = (0.0, 1.0, 2.0, 3.0, 5.0, 8.0, 10.0)


def status_counts(log: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return log.groupBy(*keys, "status").agg(F.count("*").alias("requests"))


def bucket_aggregates(value: Column, bounds: tuple[float, ...]) -> list[Column]:
    """Counts at or below each bound, all rows, and the sum: one aggregation for the whole histogram."""
    buckets = [F.count_if(value <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return [*buckets, F.count(value).alias("n"), F.sum(value).alias("total")]


def bucket_rows(wide: DataFrame, bounds: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, le, cumulative, total): one row per bound and one for ``+Inf``."""
    pairs = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"le_{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("cumulative")))
    return wide.select(*keys, "total", F.explode(F.array(*pairs)).alias("b")).select(
        *keys, "b.le", "b.cumulative", F.round("total", 6).alias("total")
    )


def histogram(log: DataFrame, column: str, bounds: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    wide = log.groupBy(*keys).agg(*bucket_aggregates(F.col(column), bounds))
    return bucket_rows(wide, bounds, keys)


def request_metrics(log: DataFrame) -> DataFrame:
    """(metric, label, value): requests by status, then both histograms with their counts and sums."""

    def rows(name: str, h: DataFrame) -> DataFrame:
        bucket = h.select(F.lit(f"{name}_bucket").alias("metric"), F.col("le").alias("label"), F.col("cumulative").cast("double").alias("value"))
        total = h.where(F.col("le") == "+Inf")
        count = total.select(F.lit(f"{name}_count").alias("metric"), F.lit("").alias("label"), F.col("cumulative").cast("double").alias("value"))
        summed = total.select(F.lit(f"{name}_sum").alias("metric"), F.lit("").alias("label"), F.col("total").alias("value"))
        return bucket.unionByName(count).unionByName(summed)

    by_status = status_counts(log).select(
        F.lit("requests_total").alias("metric"), F.col("status").alias("label"), F.col("requests").cast("double").alias("value")
    )
    latency = rows("latency_seconds", histogram(log, "latency_s", LATENCY_BOUNDS))
    retrieved = rows("retrieved_docs", histogram(log, "retrieved", RETRIEVED_BOUNDS))
    return by_status.unionByName(latency).unionByName(retrieved)
