"""State per document: late, repeated and corrected rows, and the table that follows them."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.functions import text as tx
from runlore.operators.features import HashedTfIdf
from runlore.operators.partitioned_table import PartitionedTable
from runlore.settings import ChunkSettings
from runlore.streaming import jobs, versions

DOCS = "document_id string, version bigint, document_type string, title string, content_text string"


def land(spark, folder, rows):
    df = spark.createDataFrame([(d, v, "documentation", "t", x) for d, v, x in rows], DOCS).withColumn("content_hash", tx.content_hash(F.col("content_text")))
    df.coalesce(1).write.mode("append").parquet(folder)
    return df.schema


def test_news_only(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run(rows):
        schema = land(spark, folder, rows)
        news = versions.newest_versions(jobs.read_stream(spark, folder, schema))
        got = []

        def take(batch, _):
            got.extend(sorted((r.document_id, r.version, r.content_text) for r in batch.collect()))

        news.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return got

    assert run([("a", 1, "one"), ("a", 3, "three"), ("a", 2, "two"), ("b", 1, "x"), (None, 1, "y"), ("c", None, "z")]) == [("a", 3, "three"), ("b", 1, "x")]
    assert run([("a", 2, "late"), ("b", 1, "x"), ("b", 2, "x")]) == []  # late, repeated, a new version of the same content
    assert run([("b", 2, "other"), ("b", 3, "new"), ("d", 5, "d")]) == [("b", 3, "new"), ("d", 5, "d")]


def test_state_that_expires_needs_a_running_stream(spark, tmp_path):
    schema = land(spark, str(tmp_path / "in"), [("a", 1, "one")])
    stream = jobs.read_stream(spark, str(tmp_path / "in"), schema)
    with pytest.raises(ValueError, match="keeps running"):
        versions.follow_documents(stream, None, None, str(tmp_path / "state"), ttl_seconds=3600)
    query = versions.newest_versions(stream, ttl_seconds=3600).writeStream.format("memory").queryName("kept_for_an_hour").outputMode("update").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        until = time.monotonic() + 60
        while time.monotonic() < until and not spark.table("kept_for_an_hour").count():
            time.sleep(1)
        assert [r.document_id for r in spark.table("kept_for_an_hour").collect()] == ["a"]
    finally:
        query.stop()


def test_the_table_follows_corrections(spark, tmp_path):
    folder, settings = str(tmp_path / "in"), ChunkSettings(size=4, overlap=0, section_min=1, section_overlap=0)
    first = [(f"d{i}", 1, " ".join(f"w{i}x{j}" for j in range(10))) for i in range(12)]
    schema = land(spark, folder, first)
    model = HashedTfIdf(16).fit(spark.read.parquet(folder), "content_text")
    chunk_schema = T.StructType([T.StructField(c, T.StringType()) for c in ("chunk_id", "document_id", "content_hash", "text")])
    table = PartitionedTable(spark, str(tmp_path / "table"), chunk_schema, 4)

    def run():
        stream = jobs.read_stream(spark, folder, schema)
        versions.follow_documents(stream, table, model, str(tmp_path / "state"), settings).awaitTermination()
        return {d: sorted(r.text for r in table.read().where(F.col("document_id") == d).collect()) for d in ("d0", "d1", "d2")}

    assert [len(x) for x in run().values()] == [3, 3, 3] and table.read().count() == 36
    land(spark, folder, [("d0", 2, "short now"), ("d1", 0, "too late"), ("d2", 2, ""), ("d2", 1, "older")])
    got = run()
    assert got["d0"] == ["short now"] and len(got["d1"]) == 3 and got["d2"] == [] and table.read().count() == 31
    newest = versions.batch_newest(spark.read.parquet(folder))
    assert newest.count() == 12 and newest.where("document_id = 'd0'").first().content_text == "short now"
