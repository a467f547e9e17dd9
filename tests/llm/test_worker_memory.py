"""What executors hold beside their heap: batches of texts, and Python workers."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from runlore.llm import common, ngram_join, quality
from runlore.session import small_table

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_stages_send_small_batches(spark):
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, "64m")
        rows = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text", "CAST(NULL AS string) AS lang", "'s' AS source")
        corpus_pipeline.language_id(spark, rows, "")

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

        got = rows.select("text").mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 2000 and max(r.size for r in got) < 2 * common.BATCH_BYTES
    finally:
        spark.conf.set(BATCH, before)


def test_small_tables_start_no_python(spark):
    got = small_table(spark, [("a", 1), (None, 2)], "lang string, cut bigint")
    assert [tuple(r) for r in got.collect()] == [("a", 1), (None, 2)]
    assert small_table(spark, [], "lang string, cut bigint").collect() == []
    assert "Python" not in got._jdf.queryExecution().toRdd().toDebugString()
    assert "Python" not in common.in_order(spark.range(5), "id")[0]._jdf.queryExecution().toRdd().toDebugString()


def peak_of(work):
    """MB that ``work`` holds at most beside what was there."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_texts_are_looked_at_in_small_parts():
    texts = [" ".join(f"word{(i * 7919 + k) % 9973}" for k in range(400)) for i in range(1000)]  # 3.4 MB
    net = quality.Network(quality.Fit())
    got = []
    assert peak_of(lambda: got.extend(quality.scores(net, texts, 50))) < 45
    whole = np.round(net.forward(*quality.encode(texts, 50))[0], 6)
    assert len(got) == 1000 and np.allclose(got, whole, atol=2e-6)

    batch = pa.RecordBatch.from_pydict({"text": texts})
    sizes = []
    assert peak_of(lambda: sizes.extend(len(s) for _, s in ngram_join._sets(batch, 5))) < 15
    assert sizes == [len(s) for s in ngram_join.ngram_sets(texts, 5)]
