"""Incident tickets: JSON and CSV files, and landed records of a remote ticket table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore import schemas
from runlore.functions import text as tx
from runlore.sources.documents import conform, content, path_exists

CORRUPT = "_corrupt_record"
RESOLVED_STATE = "6"
LOOKBACK_DAYS = 90


def read_ticket_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of tickets, the form for large sources: files are split, and an unreadable line is one row with
    ``_corrupt_record`` set."""
    schema = T.StructType([*schemas.TICKETS.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "pathGlobFilter": "*.jsonl"}
    return spark.read.schema(schema).options(**options).json(path)


def read_ticket_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of tickets, a task for each file; an unreadable file becomes one row with ``_corrupt_record`` set."""
    schema = T.StructType([*schemas.TICKETS.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )


def read_ticket_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row; every value is text, so ``tags`` is a one-element list of the cell.

    Files read together must have one header; a file with another one is an error, not misread.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("pathGlobFilter", "*.csv")
        .csv(path)
    )
    cells = {c.lower(): c for c in raw.columns}
    columns = []
    for f in schemas.TICKETS.fields:
        cell = F.col(f"`{cells[f.name]}`") if f.name in cells else F.lit(None).cast("string")
        value = F.when(cell.isNotNull(), F.array(cell)) if f.name == "tags" else cell
        columns.append(value.cast(f.dataType).alias(f.name))
    return raw.select(*columns, F.lit(None).cast("string").alias(CORRUPT))


def read_tickets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tickets of a file or of the ``.json``, ``.jsonl`` and ``.csv`` files right under a folder: (good, set aside)."""
    if path.endswith(".csv"):
        rows = read_ticket_csv(spark, path)
    elif path.endswith(".jsonl"):
        rows = read_ticket_lines(spark, path)
    elif path.endswith(".json"):
        rows = read_ticket_json(spark, path)
    else:
        rows = read_ticket_json(spark, path)
        if path_exists(spark, f"{path.rstrip('/')}/*.jsonl"):
            rows = rows.unionByName(read_ticket_lines(spark, path))
        if path_exists(spark, f"{path.rstrip('/')}/*.csv"):
            rows = rows.unionByName(read_ticket_csv(spark, path))
    # Spark refuses to read the corrupt column alone, so a condition that always holds looks at an ordinary one.
    rows = rows.where(F.length(F.concat_ws("", "id")) >= 0)
    good = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = rows.where(F.col(CORRUPT).isNotNull())
    return good, bad.select(F.lit("ticket_system").alias("source_system"), "id", CORRUPT)


def ticket_text(strict: bool = True) -> Column:
    """Labelled parts in fixed order, empty ones left out."""
    # The labels and their order.
    parts = (
        ("Incident: ", "title"),
        ("Priority: ", "priority"),
        ("Affected Service: ", "service"),
        ("Description:\n", "description"),
        ("Error:\n", "error_message"),
        ("Resolution:\n", "resolution_notes"),
        ("Root Cause: ", "root_cause"),
    )
    return content(F.concat_ws("\n\n", *[tx.labelled(label, F.col(name)) for label, name in parts]), strict)


def ticket_documents(tickets: DataFrame, strict: bool = False, now: Column | None = None) -> DataFrame:
    rows = tickets.withColumn("content_text", ticket_text(strict))
    # Defaults of missing keys.
    return conform(
        rows.select(
            F.concat(F.lit("ticket_"), F.coalesce("id", tx.stable_suffix(F.col("content_text"), 16))).alias("document_id"),
            F.lit("ticket_system").alias("source_system"),
            F.lit("incident_ticket").alias("document_type"),
            tx.or_default(F.col("title"), "Untitled Incident").alias("title"),
            "content_text",
            tx.parse_iso(F.col("created_at"), now).alias("created_at"),
            tx.parse_iso(F.coalesce(F.nullif("resolved_at", F.lit("")), "created_at"), now).alias("last_modified"),
            tx.or_default(F.col("service"), "unknown").alias("service"),
            tx.or_default(F.col("priority"), "unknown").alias("priority"),
            tx.or_default(F.col("status"), "unknown").alias("status"),
            tx.or_default(F.col("environment"), "production").alias("environment"),
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
            F.create_map(F.lit("root_cause"), tx.or_default(F.col("root_cause"), "")).alias("metadata"),
        )
    )


def resolved_since(records: DataFrame, days: int = LOOKBACK_DAYS, now: Column | None = None) -> DataFrame:
    """Resolved records created in the last ``days``; only the needed fields are read."""
    now = now if now is not None else F.current_timestamp()
    created = F.try_to_timestamp(F.concat("sys_created_on", F.lit(" Z")), F.lit("yyyy-MM-dd HH:mm:ss X"))
    recent = created > now - F.make_dt_interval(days=F.lit(days))
    kept = [c for c in records.columns if c in schemas.REMOTE_TICKETS.names]
    return records.where((F.col("state.value") == RESOLVED_STATE) & recent).select(*kept)


def remote_ticket_documents(records: DataFrame, strict: bool = False, now: Column | None = None) -> DataFrame:
    """Landed remote records as documents; here every label is written, with or without a value."""
    display = {c: tx.or_default(F.col(f"{c}.display_value"), "") for c in ("priority", "state")}
    # The labels and their order.
    parts = (
        ("Incident: ", tx.or_default(F.col("short_description"), "")),
        ("Category: ", tx.or_default(F.col("category"), "")),
        ("Priority: ", display["priority"]),
        ("Service: ", tx.or_default(F.col("u_service_name"), "")),
        ("Description:\n", tx.or_default(F.col("description"), "")),
        ("Resolution:\n", tx.or_default(F.col("close_notes"), "")),
        ("Root Cause: ", tx.or_default(F.col("u_root_cause"), "")),
    )
    raw = F.concat_ws("\n\n", *[F.concat(F.lit(label), value) for label, value in parts])
    return conform(
        records.select(
            F.concat(F.lit("snow_"), tx.or_default(F.col("sys_id"), "")).alias("document_id"),
            F.lit("servicenow").alias("source_system"),
            F.lit("incident_ticket").alias("document_type"),
            tx.or_default(F.col("short_description"), "").alias("title"),
            content(raw, strict).alias("content_text"),
            tx.parse_utc(F.col("sys_created_on"), now).alias("created_at"),
            tx.parse_utc(F.col("sys_updated_on"), now).alias("last_modified"),
            display["priority"].alias("priority"),
            tx.or_default(F.col("u_service_name"), "").alias("service"),
            F.create_map(
                F.lit("number"), tx.or_default(F.col("number"), ""), F.lit("state"), display["state"]
            ).alias("metadata"),
        )
    )
