"""Runbooks and post-mortems: whole text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.functions import text as tx
from runlore.sources.documents import conform, content

# The file patterns read by default.
PATTERNS = ("*.md", "*.txt", "*.rst")


def read_text_files(
    spark: SparkSession, path: str, patterns: tuple[str, ...] = PATTERNS, recursive: bool = True
) -> DataFrame:
    """(path, text, created_at, last_modified); bytes that are not UTF-8 become the replacement character.

    File systems behind Spark report a change time only, so it stands for both times.
    """
    glob = "{" + ",".join(patterns) + "}"
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", recursive)
        .load(path)
    )
    return files.select(
        "path",
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
        F.col("modificationTime").alias("created_at"),
        F.col("modificationTime").alias("last_modified"),
    )


def file_documents(files: DataFrame, strict: bool = False, language: Column | None = None) -> DataFrame:
    """Titles, headings and types of text files. ``language`` is a column expression, English when not given."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"(?s)(.)\.[^.]*$", "$1")
    rows = files.withColumn("file_name", name).withColumn("stem", stem).withColumn("content_text", content(F.col("text"), strict))
    body = F.col("content_text")
    return conform(
        rows.select(
            F.concat(F.lit("runbook_"), F.col("stem"), F.lit("_"), tx.stable_suffix(body, 6)).alias("document_id"),
            F.lit("local_files").alias("source_system"),
            tx.classify(F.col("path"), body).alias("document_type"),
            F.coalesce(tx.first_heading(body), tx.title_from_stem(F.col("stem"))).alias("title"),
            "content_text",
            "created_at",
            "last_modified",
            tx.headings(body).alias("section_headings"),
            (language if language is not None else F.lit("en")).alias("language"),
            F.create_map(
                F.lit("file_path"), F.col("path"), F.lit("file_name"), F.col("file_name"),
                F.lit("word_count"), tx.word_count(body).cast("string"),
            ).alias("metadata"),
        )
    )
