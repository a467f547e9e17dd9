"""Sources as objects, and the run that reads them all."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore import schemas
from runlore.sources import alerts, files, tickets, wiki
from runlore.sources.documents import ingest_counts, path_exists, require_documents, union_sources


class Source(Protocol):
    """Anything that yields rows of the documents schema, and the rows it had to set aside."""

    path: str

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame | None]: ...


@dataclass(frozen=True)
class TicketFiles:
    path: str
    strict: bool = False

    def read(self, spark):
        good, bad = tickets.read_tickets(spark, self.path)
        return tickets.ticket_documents(good, self.strict), bad.select("source_system")


@dataclass(frozen=True)
class RemoteTickets:
    """Landed JSON lines of a remote ticket table."""

    path: str
    lookback_days: int = tickets.LOOKBACK_DAYS
    strict: bool = False

    def read(self, spark):
        records = spark.read.schema(schemas.REMOTE_TICKETS).json(self.path)
        return tickets.remote_ticket_documents(tickets.resolved_since(records, self.lookback_days), self.strict), None


@dataclass(frozen=True)
class TextFiles:
    path: str
    patterns: tuple[str, ...] = files.PATTERNS
    recursive: bool = True
    strict: bool = False

    def read(self, spark):
        return files.file_documents(files.read_text_files(spark, self.path, self.patterns, self.recursive), self.strict), None


@dataclass(frozen=True)
class WikiPages:
    path: str
    base_url: str
    spaces: list[str] | None = None
    strict: bool = False

    def read(self, spark):
        return wiki.wiki_documents(wiki.read_wiki_pages(spark, self.path), self.base_url, self.spaces, self.strict), None


@dataclass(frozen=True)
class Alerts:
    """Parquet events."""

    path: str
    event_type: str = "error"

    def read(self, spark):
        return alerts.alert_documents(spark.read.parquet(self.path), self.event_type), None


@dataclass(frozen=True)
class Ingest:
    documents: DataFrame
    counts: DataFrame
    warnings: list[str] = field(default_factory=list)


def ingest(spark: SparkSession, sources: list[Source], profiles: DataFrame | None = None) -> Ingest:
    """All sources that exist as one documents table; a missing one is a warning, none at all an error."""
    found, warnings = [], []
    for s in sources:
        if path_exists(spark, s.path):
            found.append(s.read(spark))
        else:
            warnings.append(f"{type(s).__name__}: nothing at {s.path}")
    documents = require_documents(union_sources(*[good for good, _ in found]))
    if profiles is not None:
        documents = with_languages(documents, profiles)
    none = spark.createDataFrame([], "source_system string")
    bad = none
    for _, set_aside in found:
        bad = bad if set_aside is None else bad.unionByName(set_aside)
    return Ingest(documents, ingest_counts(documents, bad), warnings)


def with_languages(documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """Detected languages in place of the default of the file source."""
    from runlore.operators.language import detect_languages

    named = documents.select("document_id", F.col("content_text").alias("text")).dropDuplicates(["document_id"])
    found = detect_languages(named, profiles, "document_id")
    return documents.drop("language").join(found, "document_id", "left").select(*documents.columns)
