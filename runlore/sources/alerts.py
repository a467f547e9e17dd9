"""Alerts: rows of an event table as documents of type ``alert``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.sources.documents import conform, content


def alert_documents(events: DataFrame, event_type: str = "error", strict: bool = False) -> DataFrame:
    """One short document per event of the type, from (event_id, ts, user_id, event_type, value, props)."""
    at = F.col("ts").cast("timestamp")
    raw = F.concat_ws(
        " ",
        F.format_string("Alert %s fired.", F.col("event_type")),
        F.format_string("User %d affected.", F.col("user_id")),
        F.format_string("Value %.2f measured.", F.col("value")),
        F.format_string("Properties %s", F.col("props")),
    )
    return conform(
        events.where(F.col("event_type") == event_type).select(
            F.format_string("alert_%d", F.col("event_id")).alias("document_id"),
            F.lit("alerts").alias("source_system"),
            F.lit("alert").alias("document_type"),
            F.format_string("Alert %s", F.col("event_type")).alias("title"),
            content(raw, strict).alias("content_text"),
            at.alias("created_at"),
            at.alias("last_modified"),
        )
    )
