"""Wiki pages: landed page records, or any table of (id, url, html)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore import schemas
from runlore.functions import text as tx
from runlore.functions.html import html_to_text
from runlore.sources.documents import conform, content


def read_wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.WIKI_PAGES).json(path)


def wiki_documents(
    pages: DataFrame, base_url: str, spaces: list[str] | None = None, strict: bool = False, now: Column | None = None
) -> DataFrame:
    """Pages of the wanted spaces, HTML stripped."""
    if spaces is not None:
        pages = pages.where(F.col("space_key").isin(*spaces))
    now = now if now is not None else F.current_timestamp()
    url = F.concat(F.lit(f"{base_url}/wiki"), tx.or_default(F.col("_links.webui"), ""))
    return conform(
        pages.select(
            F.concat(F.lit("confluence_"), "id").alias("document_id"),
            F.lit("confluence").alias("source_system"),
            F.lit("documentation").alias("document_type"),
            "title",
            content(html_to_text(F.col("body.storage.value")), strict).alias("content_text"),
            now.alias("created_at"),
            now.alias("last_modified"),
            F.create_map(
                F.lit("space_key"), F.col("space_key"), F.lit("confluence_id"), F.col("id"), F.lit("url"), url
            ).alias("metadata"),
        )
    )


def html_documents(pages: DataFrame, strict: bool = False, now: Column | None = None) -> DataFrame:
    """A table (page_id, url, html) as wiki documents: the space is the URL's host, the title the page's title."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    records = pages.select(
        F.col("page_id").cast("string").alias("id"),
        tx.clean_text(title).alias("title"),
        F.parse_url("url", F.lit("HOST")).alias("space_key"),
        F.struct(F.struct(F.col("html").alias("value")).alias("storage")).alias("body"),
        F.struct(F.parse_url("url", F.lit("PATH")).alias("webui")).alias("_links"),
    )
    return wiki_documents(records, "", strict=strict, now=now)
