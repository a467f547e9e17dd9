"""The documents table: one shape for every source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore import schemas
from runlore.functions import text as tx


def content(raw: Column, strict: bool) -> Column:
    """Cleaned and redacted text. ``strict`` flattens lines as well, so no heading or blank line is left for the
    operators after it; otherwise lines are kept."""
    return tx.redact(tx.clean_text(raw) if strict else tx.clean_text_keep_lines(raw))


def conform(df: DataFrame) -> DataFrame:
    """Add the derived columns and bring the rows to the documents schema; columns a source lacks are null."""
    derived = df.withColumn("content_hash", tx.content_hash(F.col("content_text"))).withColumn(
        "word_count", tx.word_count(F.col("content_text"))
    )
    known = F.col("document_type").isin(*schemas.DOCUMENT_TYPES)
    derived = derived.withColumn("document_type", F.when(known, F.col("document_type")).otherwise("unknown"))
    have = set(derived.columns)
    return derived.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.DOCUMENTS.fields
        ]
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources as one table. No source at all is an error."""
    if not sources:
        raise ValueError("no documents found: give at least one source")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def available(spark: SparkSession, paths: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """Sources that can be read, and warnings for those that are missing."""
    found = {name: p for name, p in paths.items() if path_exists(spark, p)}
    return found, [f"source {name} not found at {p}" for name, p in paths.items() if name not in found]


def require_documents(documents: DataFrame) -> DataFrame:
    if documents.isEmpty():
        raise ValueError("no documents found")
    return documents


def ingest_counts(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows read and rows set aside, per source."""
    rows = good.select("source_system", F.lit(1).alias("ok")).unionByName(bad.select("source_system", F.lit(0).alias("ok")))
    return rows.groupBy("source_system").agg(
        F.sum("ok").alias("ingested"), F.sum(1 - F.col("ok")).alias("errors")
    )


def to_json(documents: DataFrame) -> DataFrame:
    """(document_id, json): ISO times, metadata as an object."""
    return documents.select("document_id", F.to_json(F.struct(*documents.columns)).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """Documents back from ``to_json``; hash and word count are computed again, not trusted."""
    parsed = rows.select(F.from_json("json", schemas.DOCUMENTS).alias("d")).select("d.*")
    return conform(parsed.drop("content_hash", "word_count"))
