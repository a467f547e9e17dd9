"""Queries that run the streaming jobs over the test tables to their end and read what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.functions import text as tx
from runlore.operators.features import HashedTfIdf
from runlore.operators.partitioned_table import PartitionedTable
from runlore.operators.request_metrics import LATENCY_BOUNDS
from runlore.queries.base import SQL, chunk_sql, query, table, type_of_source
from runlore.queries.documents import DOC_SQL, paragraphs
from runlore.queries.indexing import RUN_LOG_SQL
from runlore.session import scratch_path
from runlore.sources.documents import conform
from runlore.streaming import jobs


def table_stream(spark, sf, name):
    """A test table as a stream, be it one file or a folder of them: a pattern may match either."""
    return jobs.read_stream(spark, f"{sf}/{name}.parque[t]", table(spark, sf, name).schema)


def document_stream(spark, sf):
    return table_stream(spark, sf, "documents")


def to_documents(text):
    def run(raw):
        return conform(
            raw.select(
                F.concat(F.lit("doc_"), "doc_id").alias("document_id"),
                F.lit("local_files").alias("source_system"),
                type_of_source().alias("document_type"),
                text.alias("content_text"),
                F.concat(F.lit("Note "), "doc_id").alias("title"),
            )
        )

    return run


@query("stream_chunks", SQL["chunks_by_type"])
def stream_chunks(spark, sf):
    """Continuous ingest gives the chunks of the batch form."""
    chunks = jobs.ingest_chunks(document_stream(spark, sf), to_documents(paragraphs()))
    out = scratch_path(spark, "stream-chunks")
    jobs.write_chunks(chunks, out, scratch_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).select(
        "chunk_id", "document_id", "chunk_index", "total_chunks", "token_count", "strategy", "text"
    )


@query(
    "stream_index",
    f"""WITH {DOC_SQL}, sli AS (SELECT id, text FROM src), {chunk_sql('ch', 'sli', 'sliding_window')}
    SELECT printf('%s_chunk_%04d', id, i) AS chunk_id, 128::BIGINT AS dimensions, sha256(text) AS content_hash, sha256(text) AS text_hash, TRUE AS own FROM ch""",
)
def stream_index(spark, sf):
    """Continuous indexing, run twice over the same files: the second run adds nothing. Each row's vector is its text's."""
    clean = tx.redact(tx.clean_text(F.col("text")))
    strings = [T.StructField(c, T.StringType()) for c in ("chunk_id", "document_id", "content_hash", "text")]
    store = PartitionedTable(spark, scratch_path(spark, "stream-index"), T.StructType([*strings, T.StructField("embedding", T.ArrayType(T.FloatType()))]), 16)
    featurizer = HashedTfIdf(128).fit(table(spark, sf, "documents"))
    for name in ("first", "second"):
        chunks = jobs.ingest_chunks(
            document_stream(spark, sf), lambda raw: to_documents(clean)(raw).withColumn("document_type", F.lit("documentation"))
        )
        jobs.index_stream(chunks, store, featurizer, scratch_path(spark, "stream-state"), name=name).awaitTermination()
    rows = store.read()
    again = featurizer.transform(rows.select("chunk_id", "text")).select("chunk_id", F.col("embedding").alias("wanted"))
    apart = F.aggregate(F.zip_with("embedding", "wanted", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: F.greatest(a, x.cast("double")))
    return rows.join(again, "chunk_id").select(
        "chunk_id", F.size("embedding").alias("dimensions"), "content_hash", tx.content_hash(F.col("text")).alias("text_hash"), (apart < 1e-5).alias("own")
    )


def _window_sql() -> str:
    bounds = " UNION ALL ".join(
        f"SELECT w, status, '{b:g}' AS le, count(*) FILTER (WHERE latency_s <= {b}) AS cumulative, round(sum(latency_s), 6) AS total FROM closed GROUP BY w, status"
        for b in LATENCY_BOUNDS
    )
    return f"""WITH {RUN_LOG_SQL}, closed AS (SELECT *, date_trunc('hour', ts) AS w FROM run_log
      WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM run_log))
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, status, le, cumulative, total FROM ({bounds}
      UNION ALL SELECT w, status, '+Inf', count(*), round(sum(latency_s), 6) FROM closed GROUP BY w, status)"""


@query("stream_request_metrics", _window_sql())
def stream_request_metrics(spark, sf):
    """Hourly latency buckets of the run log, as far as the watermark has passed."""
    events = table_stream(spark, sf, "events")
    # Event time in the stream is an instant; the table's times carry no zone and are taken as UTC.
    log = events.select(
        F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z"))).alias("ts"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        (F.col("value") / 10).alias("latency_s"),
    )
    out = scratch_path(spark, "stream-windows")
    jobs.write_windows(jobs.windowed_metrics(log), out, scratch_path(spark, "stream-state")).awaitTermination()
    rows = jobs.window_rows(spark.read.parquet(out))
    utc = F.to_utc_timestamp("window_start", F.current_timezone())
    return rows.withColumn("window_start", F.date_format(utc, "yyyy-MM-dd HH:mm:ss"))
