"""Streams over test tables that are one file or a folder of files."""

import pytest
from pyspark.sql import functions as F

from runlore.queries.streams import stream_chunks, stream_request_metrics, table_stream

ROWS = [(i, f"Text {i} tells of a pool.\n\nIt was full.", "en", f"src{i}", 30) for i in range(20)]


def tables(spark, folder, files):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    if files:
        docs.repartition(files).write.parquet(f"{folder}/documents.parquet")
        return folder
    docs.coalesce(1).write.parquet(f"{folder}/written")
    (part,) = (folder / "written").glob("part-*.parquet")
    (folder / "documents.parquet").write_bytes(part.read_bytes())
    return folder


@pytest.mark.parametrize("files", [0, 3])
def test_documents_of_a_file_or_a_folder_are_streamed(spark, tmp_path, files):
    sf = tables(spark, tmp_path, files)
    got = stream_chunks(spark, str(sf)).select("document_id").distinct()
    assert sorted(r[0] for r in got.collect()) == sorted(f"doc_{i}" for i in range(20))


def test_events_of_a_folder_are_streamed(spark, tmp_path):
    events = spark.range(100).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"),
        F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"))
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert table_stream(spark, str(tmp_path), "events").isStreaming
    assert stream_request_metrics(spark, str(tmp_path)).count() > 0
