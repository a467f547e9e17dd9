"""Explicit schemas; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

# The document types.
DOCUMENT_TYPES = ("incident_ticket", "runbook", "post_mortem", "documentation", "alert", "unknown")


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_STRING_ARRAY = T.ArrayType(T.StringType())

TICKETS = T.StructType(
    _strings(
        "id", "title", "description", "error_message", "resolution_notes", "root_cause", "priority",
        "service", "status", "environment", "created_at", "resolved_at",
    )
    + [T.StructField("tags", _STRING_ARRAY)]
)

_DISPLAY = T.StructType(_strings("display_value", "value"))

REMOTE_TICKETS = T.StructType(
    _strings(
        "sys_id", "number", "short_description", "description", "close_notes", "category", "u_service_name",
        "u_root_cause", "u_resolution_summary", "sys_created_on", "sys_updated_on",
    )
    + [T.StructField("priority", _DISPLAY), T.StructField("state", _DISPLAY)]
)

WIKI_PAGES = T.StructType(
    _strings("id", "title", "space_key")
    + [
        T.StructField("body", T.StructType([T.StructField("storage", T.StructType(_strings("value")))])),
        T.StructField("_links", T.StructType(_strings("webui"))),
    ]
)

DOCUMENTS = T.StructType(
    _strings("document_id", "source_system", "document_type", "title", "content_text")
    + [T.StructField("created_at", T.TimestampType()), T.StructField("last_modified", T.TimestampType())]
    + _strings("content_hash")
    + [T.StructField("word_count", T.IntegerType())]
    + _strings("service", "priority", "status", "environment")
    + [T.StructField("tags", _STRING_ARRAY), T.StructField("section_headings", _STRING_ARRAY)]
    + _strings("language")
    + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)

EVAL_SAMPLES = T.StructType(
    _strings(
        "incident_id", "title", "description", "service", "priority", "environment", "error_message",
        "ground_truth_root_cause",
    )
)

INCIDENTS = T.StructType(
    _strings("incident_id", "title", "description", "service", "priority", "environment", "error_message", "error_code")
    + [
        T.StructField("affected_components", _STRING_ARRAY),
        T.StructField("recent_deployments", _STRING_ARRAY),
        T.StructField("alert_labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

# Model replies: numbers and booleans are read as text, because a quoted "0.4" read as a double would be null.
REPLY = T.StructType(
    [
        T.StructField("root_causes", T.ArrayType(T.StructType(_strings("hypothesis", "confidence", "evidence")))),
        T.StructField("confidence_score", T.StringType()),
        T.StructField("remediation_steps", _STRING_ARRAY),
        T.StructField("requires_escalation", T.StringType()),
        T.StructField("escalation_reason", T.StringType()),
        T.StructField("related_docs", T.ArrayType(T.StructType(_strings("title", "document_id", "relevance")))),
        T.StructField("diagnostic_summary", T.StringType()),
    ]
)
