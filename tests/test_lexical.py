import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runlore.operators import lexical, rerank as rr
from runlore.plans.index_build import lexical_base
from runlore.plans.retrieval import retrieve
from runlore.settings import RetrievalSettings


def tables(spark, texts, asked):
    c = spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    return c, spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")


def brute(texts, asked, k):
    docs = [Counter(t.lower().split()) for t in texts]
    n, mean = len(docs), sum(sum(d.values()) for d in docs) / len(docs)
    df = Counter(t for d in docs for t in d)
    out = {}
    for q, text in enumerate(asked):
        scored = []
        for i, d in enumerate(docs):
            s = sum(
                qtf * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * d[t] * 2.2
                / (d[t] + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean))
                for t, qtf in Counter(text.lower().split()).items()
                if t in d
            )
            if s:
                scored.append((-round(s, 9), f"c{i:03d}"))
        out[q] = [(c, -s) for s, c in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_bm25(spark, limit):
    rng = random.Random(2)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(80)]
    texts += texts[:20]
    asked = [" ".join(rng.choices(words, k=6)) for _ in range(9)] + ["nothing known", "THE the w1"]
    c, q = tables(spark, texts, asked)
    got = {}
    for r in lexical.bm25(c.repartition(4), q, 8, broadcast_bytes=limit).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, pytest.approx(r.score, abs=1e-8)))
    assert got == {i: r for i, r in brute(texts, asked, 8).items() if r}


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, text string, score double, rank int")


class Lengths(rr.PairFunction):
    """Longer text, higher score."""

    def __init__(self, **options):
        super().__init__(lambda: lambda pairs: [len(t) / 10 for _, t in pairs], **options)


def test_rerank_replaces_scores_and_sorts(spark):
    _, q = tables(spark, ["x"], ["any"])
    rows = candidates(spark, [(0, "a", "x" * 3, 0.9, 1), (0, "b", "x" * 9, 0.5, 2), (0, "c", "x", 0.1, 3)])
    got = rr.rerank(rows, q, Lengths(batch_size=2)).orderBy("rank").collect()
    assert [(r.chunk_id, r["rank"]) for r in got] == [("b", 1), ("a", 2), ("c", 3)]
    assert [r.score for r in got] == pytest.approx([1 / (1 + math.exp(-x)) for x in (0.9, 0.3, 0.1)])
    assert rr.rerank(rows.where("false"), q, Lengths()).count() == 0
    cut = rr.rerank(rows, q, Lengths(max_chars=2)).orderBy("rank").collect()
    assert [r.chunk_id for r in cut] == ["a", "b", "c"]


def test_coverage_sees_the_whole_text(spark):
    c, q = tables(spark, ["alpha " + "pad " * 400 + "omega", "alpha", "beta"], ["alpha omega", "unknown"])
    scorer = rr.TermCoverage().fit(q, lexical.term_statistics(c))
    rows = c.withColumn("query_id", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0))
    got = {(r.query_id, r.chunk_id): r.score for r in rr.rerank(rows, q, scorer).collect()}
    assert got[0, "c000"] == pytest.approx(1 / (1 + math.exp(-5)))
    assert got[0, "c000"] > got[0, "c001"] > got[0, "c002"] == pytest.approx(1 / (1 + math.exp(5)))
    assert got[1, "c000"] == got[0, "c002"]


def test_sparse_queries_keep_those_without_results(spark):
    _, q = tables(spark, ["x"], ["a", "b", "c"])
    passing = candidates(spark, [(0, c, "t", 0.9, 1) for c in "abc"] + [(1, "a", "t", 0.9, 1)])
    assert sorted(r.query_id for r in rr.sparse_queries(q, passing, 3).collect()) == [1, 2]


def test_expansion_falls_back_to_the_query(spark):
    _, q = tables(spark, ["x"], ["a", "b"])
    passages = spark.createDataFrame([(0, "more words")], "query_id int, passage string")
    got = dict(map(tuple, rr.expand(q, passages).select("query_id", "text").collect()))
    assert got == {0: "a\n\nmore words", 1: "b"}


def knowledge(spark):
    rows = [
        ("c1", "d1", "runbook", "Pool", "connection pool exhausted restart the pool"),
        ("c2", "d2", "runbook", "Pool two", "connection pool exhausted again"),
        ("c3", "d3", "alert", "Disk", "disk full on node clean logs"),
        ("c4", "d4", "alert", "Logs", "rotate logs when storage is short"),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, document_type string, title string, text string")
    return lexical_base(chunks)


def test_retrieval_threshold_expansion_and_cut(spark):
    _, q = tables(spark, ["x"], ["connection pool exhausted", "disk full", "zebra"])
    plain = RetrievalSettings(dense=False, filter_keys=(), expansion_enabled=False)
    kb = knowledge(spark)
    rows = [(r.query_id, r["rank"], r.chunk_id) for r in retrieve(q, kb, plain).collect()]
    assert sorted(rows) == [(0, 1, "c1"), (0, 2, "c2"), (1, 1, "c3")]
    # A passage about storage brings in another chunk, but it is scored against the query and does not pass.
    passages = spark.createDataFrame([(1, "rotate logs storage")], "query_id int, passage string")
    wide = RetrievalSettings(dense=False, filter_keys=(), threshold=0.0, final_k=3)
    got = [r.chunk_id for r in retrieve(q.where("query_id = 1"), kb, wide, passages=passages).orderBy("rank").collect()]
    assert got == ["c3", "c4"]
    strict = RetrievalSettings(dense=False, filter_keys=(), final_k=1)
    assert sorted(r.chunk_id for r in retrieve(q, kb, strict, passages=passages).collect()) == ["c1", "c3"]


@pytest.mark.parametrize("most", [10_000, 0])
def test_documents_that_hold_passages(spark, tmp_path, monkeypatch, most):
    """Runs are put together only where a passage's first word stands; with too many such words, everywhere."""
    from runlore.queries import retrieval

    monkeypatch.setattr(retrieval, "FIRST_WORDS", most)
    long = "one two three four five six seven eight nine ten"
    passages = [(1, long), (2, "short  passage"), (3, " leads with a space and goes on for long"), (4, "one two three four five six seven eight other"), (5, "")]
    texts = [(1, f"x y {long} z"), (2, "short\npassage"), (3, "  leads with a space and goes on for longer"), (4, "one two\nthree four five six seven eight nine ten"),
             (5, None), (6, ""), (7, "one one two three four five six seven eight nine"), (8, "short passage with more words than a run may have")]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en", "src1") for i, t in texts], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = retrieval.containing_documents(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(1, 1), (1, 4), (2, 2), (3, 3), (5, 6)}
    assert ("filter(sequence" in found._jdf.queryExecution().optimizedPlan().toString()) == (most > 0)
