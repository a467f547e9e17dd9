"""What a task of the top-k search holds, and which rows its queries meet."""

import numpy as np
import pyarrow as pa
import pytest

from runlore.operators import lexical, search as se, topk
from runlore.operators.topk import DenseScorer


def wide_scan(queries, rows, k, keys=(), floor=-np.inf, sizes=10_000):
    """What one task hands out, as (query, row, score), and the sizes of the parts."""
    found = list(topk._scan(rows.to_batches(max_chunksize=sizes), queries, DenseScorer, keys, False, k, ["chunk_id", *keys], floor))
    triples = [(q, r, s) for query, score, part in found for q, r, s in zip(query.tolist(), part["chunk_id"].to_pylist(), score.tolist())]
    return triples, [len(query) for query, _, _ in found]


def test_task_holds_bounded_rows_whatever_k_is(monkeypatch):
    """All rows are results of all queries: they leave the task in parts, each pair once."""
    monkeypatch.setattr(topk, "HELD_ROWS", 500)
    monkeypatch.setattr(topk, "PAIRS_HELD", 200)
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 16)
    monkeypatch.setattr(topk, "SCAN_CELLS", 1000)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(90, 4))
    rows = pa.table({"chunk_id": np.arange(90), "embedding": vectors.tolist()})
    triples, parts = wide_scan(rows.rename_columns(["query_id", "embedding"]), rows, 1_000_000, sizes=30)
    assert len(triples) == 90 * 90 == len({t[:2] for t in triples})
    assert len(parts) > 10 and max(parts) <= 1000


def test_parts_handed_out_hold_the_best(monkeypatch):
    """With less room than k rows a query the best are still among what is handed out."""
    monkeypatch.setattr(topk, "HELD_ROWS", 40)
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 8)
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(120, 4))
    unit = vectors / np.sqrt((vectors**2).sum(1, keepdims=True))
    rows = pa.table({"chunk_id": np.arange(120), "embedding": vectors.tolist()})
    triples, _ = wide_scan(rows.rename_columns(["query_id", "embedding"]), rows, 5, sizes=25)
    for q in range(120):
        best = sorted(((-s, r) for i, r, s in triples if i == q))[:5]
        assert [r for _, r in best] == np.argsort(-(unit @ unit[q]), kind="stable")[:5].tolist()


@pytest.mark.parametrize("groups", [0, 256])
def test_groups_of_equal_filters_meet_their_own_rows(monkeypatch, groups):
    monkeypatch.setattr(topk, "FILTER_GROUPS", groups)
    scored = []
    prepare = DenseScorer.prepare
    monkeypatch.setattr(DenseScorer, "prepare", lambda self, batch: scored.append(self.n * batch.num_rows) or prepare(self, batch))
    rng = np.random.default_rng(7)
    vectors, kind = rng.normal(size=(200, 4)), [None if i % 11 == 0 else i % 10 for i in range(200)]
    unit = vectors / np.sqrt((vectors**2).sum(1, keepdims=True))
    rows = pa.table({"chunk_id": np.arange(200), "kind": kind, "embedding": vectors.tolist()})
    wanted = [None if i % 50 == 0 else i % 10 for i in range(200)]
    asked = pa.table({"query_id": np.arange(200), "embedding": vectors.tolist(), "f_kind": pa.array(wanted)})
    triples, _ = wide_scan(asked, rows, 3, ("kind",), sizes=64)
    for q in range(200):
        allowed = [r for r in range(200) if wanted[q] is None or kind[r] == wanted[q]]
        best = sorted(allowed, key=lambda r: (-float(unit[r] @ unit[q]), r))[:3]
        assert [r for i, r, _ in sorted(triples, key=lambda t: (t[0], -t[2], t[1])) if i == q] == best
    assert sum(scored) == 200 * 200 if not groups else sum(scored) < 200 * 200 / 5


def test_rounds_by_number_of_results(spark, monkeypatch):
    """Few bytes of queries, but more results than a task may hold: several rounds give the same rows."""
    monkeypatch.setattr(topk, "HELD_ROWS", 100)
    made = []
    rounds = topk.rounds_topk
    monkeypatch.setattr(topk, "rounds_topk", lambda n, *args: made.append(n) or rounds(n, *args))
    v = np.random.default_rng(8).normal(size=(50, 4))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>")
    asked = rows.withColumnRenamed("chunk_id", "query_id")
    unit = v / np.sqrt((v**2).sum(1, keepdims=True))
    found = {}
    for r in sorted(se.search(rows, asked, 5).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.chunk_id)
    assert [found[i] for i in range(50)] == np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :5].tolist()
    assert made == [3]


def test_wide_rows_are_prepared_few_at_a_time(monkeypatch):
    monkeypatch.setattr(topk, "PREPARED_BYTES", 1000)
    sizes = []
    prepare = DenseScorer.prepare
    monkeypatch.setattr(DenseScorer, "prepare", lambda self, batch: sizes.append(batch.nbytes) or prepare(self, batch))
    vectors = np.random.default_rng(9).normal(size=(100, 4))
    rows = pa.table({"chunk_id": np.arange(100), "embedding": vectors.tolist()})
    triples, _ = wide_scan(rows.rename_columns(["query_id", "embedding"]), rows, 1)
    assert sorted(t[:2] for t in triples if t[2] > 0.999999) == [(i, i) for i in range(100)]
    assert max(sizes) <= 1000 and len(sizes) > 1


def test_masks_are_made_for_the_queries_asked_for():
    allowed = topk.AllowedValues(pa.table({"f_kind": pa.array([0, 1, None, 1])}), ("kind",), False)
    codes = allowed.codes(pa.RecordBatch.from_pydict({"kind": pa.array([1, 0, None])}))
    assert allowed.mask_of(np.array([3, 2]), codes).tolist() == [[True, False, False], [True, True, True]]
    assert allowed.mask(0, 2, codes).tolist() == [[False, True, False], [True, False, False]]


@pytest.mark.parametrize("metric", se.METRICS)
def test_many_results_of_a_small_corpus_are_ranked_where_the_queries_are(spark, monkeypatch, metric):
    """A k beyond what rounds are for: rows are ranked without a shuffle of them, whether all are results or not."""
    monkeypatch.setattr(topk, "ROUNDED_K", 6)
    monkeypatch.setattr(topk, "PAIRS_OF_TASK", 500)
    monkeypatch.setattr(topk, "RANKED_AT_ONCE", 100)
    monkeypatch.setattr(topk, "ROWS_AT_ONCE", 16)
    monkeypatch.setattr(topk, "PREPARED_BYTES", 1000)
    v = np.random.default_rng(10).normal(size=(60, 4))
    v[50:] = v[:10]
    kinds = [None if i % 11 == 0 else i % 3 for i in range(60)]
    rows = spark.createDataFrame([(i, x.tolist(), t) for i, (x, t) in enumerate(zip(v, kinds))], "chunk_id long, embedding array<double>, kind int")
    asked = rows.select(rows.chunk_id.alias("query_id"), "embedding", rows.kind.alias("f_kind"))
    unit = v / np.sqrt((v**2).sum(1, keepdims=True)) if metric == "cosine" else v
    scores = -((unit[:, None] - unit[None]) ** 2).sum(2) if metric == "l2" else (unit[:, None] * unit[None]).sum(2)
    for k, filtered in ((1_000_000, False), (7, False), (1_000_000, True), (7, True)):
        found = se.search(rows, asked if filtered else asked.drop("f_kind"), k, metric=metric)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("Exchange") == 1
        got = {}
        for r in sorted(found.collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 9), r["rank"]))
        for q in range(60):
            allowed = [r for r in range(60) if not filtered or kinds[q] is None or kinds[r] == kinds[q]]
            best = sorted(allowed, key=lambda r: (-scores[q, r], r))[:k]
            assert got[q] == [(r, round(scores[q, r], 9), i + 1) for i, r in enumerate(best)]


def test_blocks_of_queries_meet_in_one_reading_of_the_corpus(spark, monkeypatch):
    """Many blocks that a task may hold together are one job, and no block is over the bound."""
    written, sent = [], []
    materialise, searched = topk.materialise, topk._searched
    monkeypatch.setattr(topk, "materialise", lambda df: written.append(1) or materialise(df))
    monkeypatch.setattr(topk, "_searched", lambda c, q, blocks, *args: sent.append([b.num_rows for b in blocks]) or searched(c, q, blocks, *args))
    v = np.random.default_rng(11).normal(size=(200, 4))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>").repartition(3)
    asked = rows.withColumnRenamed("chunk_id", "query_id")
    unit = v / np.sqrt((v**2).sum(1, keepdims=True))
    found = {}
    for r in sorted(se.search(rows, asked, 5, broadcast_bytes=1000).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.chunk_id)
    assert [found[i] for i in range(200)] == np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :5].tolist()
    assert len(written) == 2  # the queries, and the results of all blocks
    assert len(sent) == 1 and len(sent[0]) == 12 and sum(sent[0]) == 200


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_bounds_leave_no_score_out(kind):
    rng = np.random.default_rng(12)
    scores = rng.normal(size=(30, 1000)).astype(kind)
    scores[3, 5:] = -np.inf
    for k in (1, 3, 500, 999):
        bound = topk.kth_bound(scores, k)
        assert ((scores >= bound[:, None]).sum(1) >= k).all()
        q, r = topk.reaching(scores, bound)
        assert set(zip(q, r)) >= set(zip(*np.nonzero((scores >= bound[:, None]) & (scores > -np.inf))))
    assert len(topk.reaching(scores, topk.kth_bound(scores, 3))[0]) < 30 * 1000 / 10


@pytest.mark.parametrize("missing", [False, True])
def test_jobs_of_equal_filters_read_the_rows_they_accept(spark, monkeypatch, missing):
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 2000)
    read, searched = [], topk._searched
    monkeypatch.setattr(topk, "_searched", lambda corpus, *args: read.append(corpus.count()) or searched(corpus, *args))
    v = np.random.default_rng(13).normal(size=(240, 4))
    kinds = [None if i % 16 == 15 else "abcd"[i % 4] for i in range(240)]
    wanted = [None if i % 60 == 59 else "abcd"[i % 4] for i in range(240)]
    rows = spark.createDataFrame([(i, x.tolist(), t) for i, (x, t) in enumerate(zip(v, kinds))], "chunk_id long, embedding array<double>, kind string")
    asked = spark.createDataFrame([(i, x.tolist(), t) for i, (x, t) in enumerate(zip(v, wanted))], "query_id long, embedding array<double>, f_kind string")
    unit = v / np.sqrt((v**2).sum(1, keepdims=True))
    found = {}
    for r in sorted(se.search(rows, asked, 4, missing_passes=missing, broadcast_bytes=1000).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.chunk_id)
    for q in range(240):
        allowed = [r for r in range(240) if wanted[q] is None or kinds[r] == wanted[q] or (missing and kinds[r] is None)]
        assert found[q] == sorted(allowed, key=lambda r: (-(unit[q] @ unit[r]), r))[:4]
    assert len(read) == 7 and sum(read) < 0.6 * 7 * 240  # 13,680 bytes, 2,000 a job; one accepts all rows


def test_hot_terms_are_a_product(monkeypatch):
    """Scores by matrix product and posting by posting are the same, also where a product has no room for all hot terms."""
    rng = np.random.default_rng(14)
    words = [f"w{i}" for i in range(40)]
    texts = [[w for i, w in enumerate(words) for _ in range(rng.integers(0, 3)) if rng.random() < 1 / (1 + i / 4)] for _ in range(70)]
    asked = [sorted({*rng.choice(words, 6), "w0", "unknown"}) for _ in range(30)]
    queries = pa.table({"query_id": np.arange(30), "terms": asked, "weights": [rng.uniform(0.1, 3, len(a)).tolist() for a in asked]})
    scorer = lexical.BM25Scorer(queries, 20.0)
    made, product = [], scorer._product
    monkeypatch.setattr(scorer, "_product", lambda hot, *args: made.append(len(hot)) or product(hot, *args))
    ready = scorer.prepare(pa.RecordBatch.from_pydict({"terms": pa.array(texts)}))
    scores = []
    for share, cells in ((64, 1 << 22), (64, 300), (0, 1 << 22)):
        monkeypatch.setattr(lexical, "PRODUCT_SHARE", share)
        monkeypatch.setattr(lexical, "PRODUCT_CELLS", cells)
        scores.append(scorer.estimate(3, 28, ready)[0])
    assert made[0] > 10 and made[1:] == [300 // (25 + 70)]
    assert np.abs(scores[0] - scores[2]).max() < 1e-8 and np.abs(scores[1] - scores[2]).max() < 1e-8 and scores[2].max() > 1
