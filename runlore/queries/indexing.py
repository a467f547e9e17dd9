"""Queries over embedding, the embedding cache, the vector table and run metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.functions import text as tx
from runlore.operators import chunking, request_metrics as rm
from runlore.operators.features import BatchFunction, HashedTfIdf, embed_with_cache, split_by_cache
from runlore.operators.search import check_dimensions
from runlore.operators.vector_table import VectorTable, changed_chunks, index_stats, new_chunks
from runlore.plans.index_build import build_index, embed_chunks, empty_cache
from runlore.queries.base import chunk_sql, query, table, texts
from runlore.queries.documents import DOC_SQL, doc_rows
from runlore.session import materialise, scratch_path

NOW = 1706659200  # 2024-01-31 00:00:00 UTC


def text_chunks(spark, sf) -> DataFrame:
    """Every document as one chunk, copies included."""
    return texts(spark, sf).select(
        F.format_string("doc_%d_chunk_0000", "doc_id").alias("chunk_id"),
        F.format_string("doc_%d", "doc_id").alias("document_id"),
        "text", "lang", tx.content_hash(F.col("text")).alias("content_hash"),
    )


@query(
    "embedding_cache_split",
    """WITH d AS (SELECT text, bool_or(lang = 'en') AS fresh FROM documents GROUP BY text)
    SELECT sha256(text) AS content_hash, CASE WHEN fresh THEN 'hit' ELSE 'miss' END AS state FROM d""",
)
def embedding_cache_split(spark, sf):
    """English texts are in the cache, German ones too but too old, the others not."""
    chunks = text_chunks(spark, sf)
    now = F.timestamp_seconds(F.lit(NOW))
    age = F.when(F.col("lang") == "en", 60).when(F.col("lang") == "de", 4000)
    cache = chunks.where(age.isNotNull()).select(
        "content_hash", F.lit("m").alias("model"), F.array(F.length("text").cast("float")).alias("embedding"),
        F.timestamp_seconds(F.lit(NOW) - age).alias("embedded_at"),
    )
    hits, misses = split_by_cache(chunks, cache, "m", 3600, now)
    return hits.select("content_hash", F.lit("hit").alias("state")).unionByName(
        misses.select("content_hash", F.lit("miss").alias("state"))
    )


@query("embedded_chunks", "SELECT count(*) AS vectors, 512::BIGINT AS min_dimensions, 512::BIGINT AS max_dimensions, TRUE AS ok FROM documents")
def embedded_chunks(spark, sf):
    """Every distinct text embedded once, then back to every chunk, copies included."""
    chunks = text_chunks(spark, sf)
    vectors, _ = embed_chunks(chunks, HashedTfIdf(512).fit(chunks))
    return check_dimensions(vectors, 512)


@query("embedding_cache_refit", "SELECT DISTINCT sha256(text) AS content_hash, TRUE AS own FROM documents")
def embedding_cache_refit(spark, sf):
    """A second fit over the cache of a first one: every vector is that of the second."""
    chunks = text_chunks(spark, sf)
    first, second = HashedTfIdf(64).fit(chunks.where("lang = 'en'")), HashedTfIdf(64).fit(chunks)
    now = F.timestamp_seconds(F.lit(NOW))
    cache = materialise(embed_with_cache(chunks, first, empty_cache(spark), now=now)[1])
    found, _ = embed_with_cache(chunks, second, cache, now=now)
    alone, _ = embed_with_cache(chunks, second, empty_cache(spark), now=now)
    both = found.join(alone.select("content_hash", F.col("embedding").alias("wanted")), "content_hash")
    return both.select("content_hash", (F.col("embedding") == F.col("wanted")).alias("own"))


def character_counts():
    """A model of the user's: what a worker loads once, from texts to vectors."""
    return lambda texts: np.array([[len(t), t.count(" "), 1] for t in texts], dtype=np.float32).reshape(-1, 3)


@query(
    "batch_function_vectors",
    """SELECT doc_id, length(text)::DOUBLE AS characters, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces, 3::BIGINT AS dimensions
    FROM documents""",
)
def batch_function_vectors(spark, sf):
    model = BatchFunction(character_counts, 3, "characters", batch_size=64)
    rows = model.fit(texts(spark, sf)).transform(texts(spark, sf).select("doc_id", "text"))
    return rows.select("doc_id", F.col("embedding")[0].cast("double").alias("characters"), F.col("embedding")[1].cast("double").alias("spaces"),
                       F.size("embedding").alias("dimensions"))


def labelled_and_all(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(chunks of labelled documents, all chunks with the rows of labelled documents twice)."""
    chunks = text_chunks(spark, sf)
    labels = table(spark, sf, "labels").select(F.format_string("doc_%d", "doc_id").alias("document_id"))
    known = chunks.join(labels, "document_id", "left_semi")
    return known, chunks.unionByName(known)


@query(
    "incremental_add",
    """SELECT 'doc_' || doc_id || '_chunk_0000' AS chunk_id, sha256(text) AS content_hash FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def incremental_add(spark, sf):
    return new_chunks(*labelled_and_all(spark, sf)).select("chunk_id", "content_hash")


@query(
    "changed_chunks",
    """SELECT 'doc_' || doc_id || '_chunk_0000' AS chunk_id FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels) AND lang <> 'en'""",
)
def changed(spark, sf):
    """Documents that are not English come again with other content."""
    known, every = labelled_and_all(spark, sf)
    other = F.when(F.col("lang") == "en", F.col("content_hash")).otherwise(F.sha2("content_hash", 256))
    return changed_chunks(known, every.withColumn("content_hash", other)).select("chunk_id")


@query(
    "index_versions",
    """SELECT 'first' AS state, 1::BIGINT AS commit, 0::BIGINT AS version, count(*) AS total_vectors FROM labels
    UNION ALL SELECT 'added', 2, 0, count(*) FROM documents UNION ALL SELECT 'again', 3, 0, count(*) FROM documents
    UNION ALL SELECT 'rebuilt', 4, 1, count(*) FROM labels UNION ALL SELECT 'pinned', 2, 0, count(*) FROM documents""",
)
def index_versions(spark, sf):
    """Add, add the same again, rebuild; the reader of an earlier commit still sees its rows."""
    known, every = labelled_and_all(spark, sf)

    def vectors(df):
        return df.select("chunk_id", "document_id", "content_hash", F.array(F.length("text").cast("float")).alias("embedding"))

    store = VectorTable(spark, scratch_path(spark, "index"))
    parts = []

    def note(state, commit):
        parts.append(
            store.read(commit).agg(F.count("*").alias("total_vectors")).select(
                F.lit(state).alias("state"), F.lit(commit.number).alias("commit"), F.lit(commit.version).alias("version"), "total_vectors"
            )
        )

    note("first", store.add(vectors(known)))
    second = store.add(vectors(every))
    note("added", second)
    note("again", store.add(vectors(every)))
    note("rebuilt", store.rebuild(vectors(known)))
    note("pinned", second)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("index_stats", "SELECT count(*) AS total_vectors, count(*) AS total_chunks, count(DISTINCT label) AS total_documents, max(len(embedding)) AS dimensions, 'flat' AS index_type FROM embeddings")
def stats(spark, sf):
    rows = table(spark, sf, "embeddings")
    return index_stats(rows.withColumnRenamed("vec_id", "chunk_id").withColumn("document_id", F.col("label")))


@query(
    "index_build",
    f"""WITH {DOC_SQL}, {chunk_sql('ch', 'src', 'sliding_window')}
    SELECT (SELECT count(*) FROM src) AS documents, count(*) AS chunks, count(*) AS vectors, 256::BIGINT AS dimensions,
      count(DISTINCT text) AS distinct_texts, count(DISTINCT text) AS embedded, 0 AS cache_hits FROM ch
    UNION ALL SELECT (SELECT count(*) FROM src), count(*), count(*), 256, count(DISTINCT text), 0, count(DISTINCT text) FROM ch""",
)
def build(spark, sf):
    """The whole build twice: the second run finds every text in the cache and adds nothing."""
    rows = materialise(doc_rows(spark, sf).withColumn("document_type", F.lit("documentation")))
    featurizer = HashedTfIdf(256).fit(chunking.chunk_documents(rows))
    store = VectorTable(spark, scratch_path(spark, "index"))
    cache = scratch_path(spark, "cache")
    first = materialise(build_index(rows, store, featurizer, cache_path=cache))
    second = build_index(rows, store, featurizer, cache_path=cache)
    return first.unionByName(second).drop("seconds")


def run_log(spark, sf) -> DataFrame:
    """The events as a run log: errors failed, the value is the latency, a property the number of documents."""
    return table(spark, sf, "events").select(
        "event_id", "ts", F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        (F.col("value") / 10).alias("latency_s"), (F.get_json_object("props", "$.k").cast("bigint") % 12).alias("retrieved"),
    )


RUN_LOG_SQL = """run_log AS (SELECT ts, CASE event_type WHEN 'error' THEN 'error' ELSE 'success' END AS status, value / 10 AS latency_s,
    CAST(json_extract(props, '$.k') AS BIGINT) % 12 AS retrieved FROM events)"""


def _histogram_sql(name: str, column: str, bounds) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}_bucket' AS metric, '{b:g}' AS label, CAST(count(*) FILTER (WHERE {column} <= {b}) AS DOUBLE) AS value FROM run_log" for b in bounds
    )
    return f"""{rows} UNION ALL SELECT '{name}_bucket', '+Inf', count({column}) FROM run_log
    UNION ALL SELECT '{name}_count', '', count({column}) FROM run_log UNION ALL SELECT '{name}_sum', '', round(sum({column}), 6) FROM run_log"""


@query(
    "request_metrics",
    f"""WITH {RUN_LOG_SQL} SELECT 'requests_total' AS metric, status AS label, CAST(count(*) AS DOUBLE) AS value FROM run_log GROUP BY status
    UNION ALL {_histogram_sql('latency_seconds', 'latency_s', rm.LATENCY_BOUNDS)}
    UNION ALL {_histogram_sql('retrieved_docs', 'retrieved', rm.RETRIEVED_BOUNDS)}""",
)
def request_metrics(spark, sf):
    return rm.request_metrics(run_log(spark, sf))


