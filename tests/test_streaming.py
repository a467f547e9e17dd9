import datetime as dt

from pyspark.sql import functions as F

from runlore.operators.features import HashedTfIdf
from runlore.operators.request_metrics import LATENCY_BOUNDS, bucket_aggregates, bucket_rows, histogram, request_metrics
from runlore.operators.vector_table import VectorTable
from runlore.streaming import jobs

DOCS = "document_id string, document_type string, title string, content_text string"


def write(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(folder)


def test_index_stream_picks_up_new_files_once(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    write(spark, folder, [("d1", "runbook", "t", "restart the pool"), ("d2", "alert", "t", "disk full. clean logs.")])
    schema = spark.read.parquet(folder).schema
    store = VectorTable(spark, str(tmp_path / "table"))
    model = HashedTfIdf(32).fit(spark.read.parquet(folder), "content_text")

    def run(checkpoint):
        chunks = jobs.ingest_chunks(jobs.read_stream(spark, folder, schema), lambda raw: raw)
        jobs.index_stream(chunks, store, model, checkpoint, name=checkpoint[-3:]).awaitTermination()
        return store.read().count()

    assert run(state) == 2
    write(spark, folder, [("d3", "runbook", "t", "new text"), ("d1", "runbook", "t", "restart the pool")])
    assert run(state) == 3
    # From the start again with a lost checkpoint: everything is there already.
    assert run(str(tmp_path / "new")) == 3


def log(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, status string, latency_s double, retrieved bigint")


def at(minute):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


def test_histogram(spark):
    rows = log(spark, [(at(0), "success", x, n) for x, n in ((0.5, 0), (0.6, 1), (31.0, 11), (2.0, 5))])
    got = {r.le: r.cumulative for r in histogram(rows, "latency_s", LATENCY_BOUNDS).collect()}
    assert got == {"0.5": 1, "1": 2, "2": 3, "3": 3, "5": 3, "10": 3, "30": 3, "+Inf": 4}
    flat = {(r.metric, r.label): r.value for r in request_metrics(rows).collect()}
    assert flat["requests_total", "success"] == 4 and flat["retrieved_docs_sum", ""] == 17
    assert flat["latency_seconds_count", ""] == 4 and flat["retrieved_docs_bucket", "0"] == 1


def test_windowed_metrics_equal_batch_for_closed_windows(spark, tmp_path):
    rows = [(at(m), "error" if m % 7 == 0 else "success", m / 10, m % 5) for m in range(0, 200, 3)]
    folder = str(tmp_path / "log")
    log(spark, rows).coalesce(1).write.parquet(folder)
    batch = spark.read.parquet(folder)
    stream = jobs.windowed_metrics(jobs.read_stream(spark, folder, batch.schema), "30 minutes", "10 minutes")
    out = str(tmp_path / "out")
    jobs.write_windows(stream, out, str(tmp_path / "state")).awaitTermination()
    got = sorted(map(tuple, jobs.window_rows(spark.read.parquet(out)).collect()))
    wide = batch.groupBy(F.window("ts", "30 minutes"), "status").agg(*bucket_aggregates(F.col("latency_s"), LATENCY_BOUNDS))
    closed = wide.where(F.col("window.end") <= F.lit(at(198 - 10))).select(F.col("window.start").alias("window_start"), *[c for c in wide.columns if c != "window"])
    assert got == sorted(map(tuple, bucket_rows(closed, LATENCY_BOUNDS, ("window_start", "status")).collect())) and got
