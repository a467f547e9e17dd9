"""Continuous forms of ingest, indexing and request metrics. Each processes what is there and stops
(``availableNow``), or keeps running with another trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from runlore.operators.chunking import chunk_documents
from runlore.operators.features import Featurizer
from runlore.operators.partitioned_table import PartitionedTable
from runlore.operators.request_metrics import LATENCY_BOUNDS, bucket_aggregates, bucket_rows
from runlore.operators.vector_table import VectorTable, one_per_chunk
from runlore.plans.index_build import embed_chunks
from runlore.settings import ChunkSettings


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options) -> DataFrame:
    """New files of a folder as a stream; the schema is always given."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def _started(writer: DataStreamWriter, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_chunks(
    raw: DataFrame, to_documents: Callable[[DataFrame], DataFrame], settings: ChunkSettings | None = None
) -> DataFrame:
    """Raw rows of a source to chunks. Cleaning, redaction and chunking keep no state, so the batch operators run on
    the stream as they are."""
    return chunk_documents(to_documents(raw), settings)


def write_chunks(chunks: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    writer = chunks.writeStream.format("parquet").option("path", out).outputMode("append")
    return _started(writer, checkpoint, trigger)


def index_stream(
    chunks: DataFrame, table: VectorTable | PartitionedTable, featurizer: Featurizer, checkpoint: str, name: str = "stream",
    trigger: dict | None = None, carry: tuple[str, ...] = ("title", "text"),
) -> StreamingQuery:
    """Embed each micro-batch and add it to the table. Ids already there are skipped, so a replayed batch adds nothing.
    Duplicates are looked up in the table, not in bounded state: in a partitioned one only where the batch's documents
    fall. One writer per table."""

    def add(batch: DataFrame, batch_id: int) -> None:
        # One row of each id is chosen before anything is derived from it, so text and vector are of one row.
        rows = one_per_chunk(batch).persist()
        vectors, _ = embed_chunks(rows, featurizer)
        extra = rows.select("chunk_id", *[c for c in carry if c in rows.columns])
        table.add(vectors.join(extra, "chunk_id"), batch=f"{name}-{batch_id}")
        rows.unpersist()

    return _started(chunks.writeStream.foreachBatch(add), checkpoint, trigger)


def windowed_metrics(log: DataFrame, window: str = "1 hour", delay: str = "10 minutes", keys: tuple[str, ...] = ("status",)) -> DataFrame:
    """Request count and latency buckets per event-time window; a window is final once the watermark passes it."""
    windowed = log.withWatermark("ts", delay).groupBy(F.window("ts", window), *keys)
    return windowed.agg(*bucket_aggregates(F.col("latency_s"), LATENCY_BOUNDS))


def window_rows(wide: DataFrame, keys: tuple[str, ...] = ("status",)) -> DataFrame:
    """Long form of the finished windows."""
    flat = wide.select(F.col("window.start").alias("window_start"), *[c for c in wide.columns if c != "window"])
    return bucket_rows(flat, LATENCY_BOUNDS, ("window_start", *keys))


def write_windows(wide: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    writer = wide.writeStream.format("parquet").option("path", out).outputMode("append")
    return _started(writer, checkpoint, trigger)
