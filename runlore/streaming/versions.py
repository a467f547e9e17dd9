"""Documents that come again: state per document decides what is news, and the table of chunks follows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from runlore.operators.chunking import chunk_documents
from runlore.operators.features import Featurizer
from runlore.operators.partitioned_table import PartitionedTable
from runlore.plans.index_build import embed_chunks
from runlore.settings import ChunkSettings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestVersion(StatefulProcessor):
    """Per document the newest version and its content hash. A row comes out when its version is newer than all before
    and its content another. What hasn't been seen for ``ttl_ms`` is forgotten and, if it comes again, news."""

    def __init__(self, columns: list[str], ttl_ms: int | None):
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "version bigint, content_hash string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        best = None
        for batch in rows:
            batch = batch.sort_values(["version", "content_hash"]).tail(1)
            if best is None or tuple(batch.iloc[0][["version", "content_hash"]]) > tuple(best.iloc[0][["version", "content_hash"]]):
                best = batch
        if best is None:
            return
        version, content = int(best.iloc[0]["version"]), str(best.iloc[0]["content_hash"])
        before = self.seen.get() if self.seen.exists() else None
        if before is None or version > before[0]:
            self.seen.update((version, content))
            if before is None or content != before[1]:
                yield best[self.columns]
        elif self.ttl_ms is not None:
            self.seen.update(tuple(before))  # seen again: it lives on

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State of this kind needs the state store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def newest_versions(documents: DataFrame, ttl_seconds: int | None = None) -> DataFrame:
    """Rows of a stream of documents (document_id, version, content_hash, ..) that are news: of each document the newest
    version, if its content is another than that of the last one. Rows without an id or version are left out.

    Of very many rows of a document in a micro-batch only the newest leaves its batches. With ``ttl_seconds`` the stream
    looks for what has expired again and again, so it needs a trigger that keeps running.
    """
    use_rocksdb(documents.sparkSession)
    known = documents.where("document_id IS NOT NULL AND version IS NOT NULL")
    schema = T.StructType([*known.schema.fields])
    processor = NewestVersion(schema.names, ttl_seconds * 1000 if ttl_seconds else None)
    mode = "ProcessingTime" if ttl_seconds else "None"
    return known.groupBy("document_id").transformWithStateInPandas(processor, schema, "Update", mode)


def follow_documents(
    documents: DataFrame, table: PartitionedTable, featurizer: Featurizer, checkpoint: str, settings: ChunkSettings | None = None,
    ttl_seconds: int | None = None, carry: tuple[str, ...] = ("title", "text"), trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the table's chunks those of each document's newest version. Each micro-batch chunks and embeds only news, and
    rewrites only the partitions of these documents. A batch that is played again writes the same again."""

    running = trigger is not None and not {"availableNow", "once"} & set(trigger)
    if ttl_seconds and not running:
        raise ValueError("state that expires is looked at for ever: give a trigger that keeps running")

    def replace(batch: DataFrame, batch_id: int) -> None:
        chunks = chunk_documents(batch.drop("version", "content_hash"), settings).persist()
        vectors, _ = embed_chunks(chunks, featurizer)
        extra = chunks.select("chunk_id", *[c for c in carry if c in chunks.columns])
        table.replace_documents(vectors.join(extra, "chunk_id"), batch.select("document_id"))
        chunks.unpersist()

    news = newest_versions(documents, ttl_seconds)
    return news.writeStream.foreachBatch(replace).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def batch_newest(documents: DataFrame) -> DataFrame:
    """What a stream over the same rows ends with, for a table that is there as a whole."""
    rest = F.struct("version", "content_hash", *[c for c in documents.columns if c not in ("document_id", "version", "content_hash")])
    known = documents.where("document_id IS NOT NULL AND version IS NOT NULL")
    return known.groupBy("document_id").agg(F.max_by(rest, F.struct("version", "content_hash")).alias("_r")).select("document_id", "_r.*")
