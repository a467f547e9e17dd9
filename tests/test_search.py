import numpy as np
import pytest
from pyspark.sql import functions as F

from runlore.operators import ann, search as se
from runlore.operators.skew import hot_keys, join_hot
from runlore.operators.topk import DenseScorer, grid_topk

WAYS = {"broadcast": 64 << 20, "rounds": 400}


def corpus(spark, vectors, services=None):
    services = services or [None] * len(vectors)
    rows = [(f"c{i:04d}", [float(x) for x in v], s) for i, (v, s) in enumerate(zip(vectors, services))]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>, service string")


def queries(spark, vectors, filters=None, kind="string"):
    filters = filters or [None] * len(vectors)
    rows = [(i, [float(x) for x in v], f) for i, (v, f) in enumerate(zip(vectors, filters))]
    return spark.createDataFrame(rows, f"query_id int, embedding array<float>, f_service {kind}")


def collected(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score))
    return {q: [(c, s) for _, c, s in sorted(rows)] for q, rows in out.items()}


def brute(vectors, wanted, k, metric="cosine", keep=lambda q, c: True):
    v, w = np.asarray(vectors, np.float32).astype(float), np.asarray(wanted, np.float32).astype(float)
    if metric == "cosine":
        v, w = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (v, w))
    out = {}
    for q, x in enumerate(w):
        s = -((v - x) ** 2).sum(axis=1) if metric == "l2" else v @ x
        order = sorted((i for i in range(len(v)) if keep(q, i)), key=lambda i: (-round(s[i], 12), i))
        out[q] = [(f"c{i:04d}", s[i]) for i in order[:k]]
    return {q: r for q, r in out.items() if r}


def same(got, want):
    assert {q: [c for c, _ in r] for q, r in got.items()} == {q: [c for c, _ in r] for q, r in want.items()}
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-6)


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("metric", se.METRICS)
def test_exact_topk(spark, way, metric):
    rng = np.random.default_rng(3)
    v, w = rng.normal(size=(300, 16)) * rng.uniform(0.1, 5, size=(300, 1)), rng.normal(size=(12, 16))
    got = collected(se.search(corpus(spark, v).repartition(5), queries(spark, w), 7, metric=metric, broadcast_bytes=WAYS[way]))
    same(got, brute(v, w, 7, metric))


@pytest.mark.parametrize("way", WAYS)
def test_copies_tie_and_break_by_id(spark, way):
    rng = np.random.default_rng(4)
    one = rng.normal(size=24)
    v = np.stack([one if i % 3 else rng.normal(size=24) for i in range(240)])
    got = collected(se.search(corpus(spark, v).repartition(7), queries(spark, [one, one * 3]), 12, broadcast_bytes=WAYS[way]))
    ids = [f"c{i:04d}" for i in range(240) if i % 3][:12]
    assert [c for c, _ in got[0]] == ids and [c for c, _ in got[1]] == ids
    assert len({s for _, s in got[0]}) == 1


def test_empty_index_short_index_and_zero_vectors(spark):
    w = queries(spark, [[1.0, 0.0], [0.0, 0.0]])
    assert se.search(corpus(spark, []), w, 3).count() == 0
    got = collected(se.search(corpus(spark, [[1, 0], [0, 0]]), w, 10))
    assert got[0] == [("c0000", 1.0), ("c0001", 0.0)]
    assert [s for _, s in got[1]] == [0.0, 0.0]


def test_lengths_must_agree(spark):
    with pytest.raises(Exception, match="dimensions"):
        se.search(corpus(spark, [[1, 0, 0]]), queries(spark, [[1.0, 0.0]]), 3).collect()
    rows = corpus(spark, [[1, 0], [0, 1]])
    assert se.check_dimensions(rows, 2).first().ok and not se.check_dimensions(rows, 3).first().ok
    assert se.check_dimensions(rows.where("false"), 3).first().ok


def filtered(services, filters, mode, k, v, w, missing_passes=False):
    def keep(q, i):
        f = filters[q]
        if f is None or (services[i] is None and missing_passes):
            return True
        return services[i] in f if isinstance(f, list) else services[i] == f

    if mode == "pre":
        return brute(v, w, k, keep=keep)
    wide = brute(v, w, 3 * k)
    out = {}
    for q, rows in wide.items():
        rows = rows[:k] if filters[q] is None else rows
        out[q] = [(c, s) for c, s in rows if keep(q, int(c[1:]))][:k]
    return {q: r for q, r in out.items() if r}


@pytest.mark.parametrize("mode", ["post", "pre"])
@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("missing", [False, True])
def test_scalar_filters(spark, mode, way, missing):
    rng = np.random.default_rng(5)
    v, w = rng.normal(size=(120, 8)), rng.normal(size=(5, 8))
    services = [["payments", "auth", None][i % 3] for i in range(120)]
    filters = ["payments", "auth", None, "search", "payments"]
    found = se.search(
        corpus(spark, v, services), queries(spark, w, filters), 6, mode, missing_passes=missing,
        broadcast_bytes=WAYS[way],
    )
    same(collected(found), filtered(services, filters, mode, 6, v, w, missing))


@pytest.mark.parametrize("mode", ["post", "pre"])
def test_list_filters_with_nulls(spark, mode):
    rng = np.random.default_rng(6)
    v, w = rng.normal(size=(90, 8)), rng.normal(size=(4, 8))
    services = [["payments", "auth", None][i % 3] for i in range(90)]
    filters = [["payments", "auth"], ["auth", None], None, []]
    found = se.search(corpus(spark, v, services), queries(spark, w, filters, "array<string>"), 6, mode)
    same(collected(found), filtered(services, filters, mode, 6, v, w))


def test_post_filter_may_return_fewer_than_k(spark):
    v = [[1, i / 100] for i in range(40)]
    services = ["other"] * 30 + ["mine"] * 10
    asked = queries(spark, [[1.0, 0.0]], ["mine"])
    assert se.search(corpus(spark, v, services), asked, 10, "post").count() == 0
    assert se.search(corpus(spark, v, services), asked, 10).count() == 10


def test_unknown_options(spark):
    c, q = corpus(spark, [[1, 0]]), queries(spark, [[1.0, 0.0]])
    for options in ({"metric": "manhattan"}, {"mode": "during"}):
        with pytest.raises(ValueError):
            se.search(c, q, 1, **options)


def test_hot_cell_is_many_blocks_and_stays_exact(spark):
    rng = np.random.default_rng(7)
    v, w = rng.normal(size=(600, 8)), rng.normal(size=(30, 8))
    rows = corpus(spark, v).withColumn("cell", F.when(F.substring("chunk_id", -1, 1) < "9", 0).otherwise(1))
    asked = queries(spark, w).select("query_id", "embedding").withColumn("cell", F.explode(F.array(F.lit(0), F.lit(1))))
    same(collected(grid_topk(rows, asked, DenseScorer, 5, ["chunk_id"], cell="cell", block_bytes=4096)), brute(v, w, 5))


def test_cells_approximate_the_exact_search(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(10, 16))
    v = np.repeat(centres, 40, axis=0) + 0.1 * rng.normal(size=(400, 16))
    w = centres + 0.1 * rng.normal(size=(10, 16))
    rows, asked = corpus(spark, v), queries(spark, w).select("query_id", "embedding")
    exact = se.search(rows, asked, 10)
    for cells, probes in ((ann.CentroidCells.fit(rows, 10), 2), (ann.ProjectionCells.fit(rows, 8, 1.0), 1)):
        found = ann.approximate_search(rows, asked, cells, 10, probes)
        assert ann.recall(found, exact).first().recall > 0.8
        assert found.groupBy("query_id").count().where("count > 10").count() == 0
    every = ann.approximate_search(rows, asked, ann.CentroidCells.fit(rows, 4), 10, 4)
    same(collected(every), brute(v, w, 10))


def test_hot_keys_join_apart(spark):
    many = spark.range(1000).select(F.when(F.col("id") < 400, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    unique = many.select("k").distinct().where("k <> 'k7'").withColumn("v", F.length("k"))
    assert hot_keys(many, "k", share=4, min_rows=100) == ["hot"]
    got = join_hot(many, unique, "k", share=4, min_rows=100)
    assert sorted(map(tuple, got.select("k", "id", "v").collect())) == sorted(map(tuple, many.join(unique, "k").select("k", "id", "v").collect()))
    assert join_hot(many, unique, "k", "left", share=4, min_rows=100).count() == 1000


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = corpus(spark, [[1, 0], [0, 1]], ["a", "b"]).withColumn("text", F.lit("long text"))
    rows.write.parquet(path)
    plan = se.search(spark.read.parquet(path), queries(spark, [[1.0, 0.0]]), 1)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(embedding)" in plan and "text" not in plan.split("ReadSchema")[1].split(">")[0]
    assert plan.count("Exchange hashpartitioning(query_id") == 1 and "WindowGroupLimit" in plan


def test_only_probed_cells_are_read(spark, tmp_path):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 16))
    rows = corpus(spark, np.repeat(centres, 30, axis=0) + 0.1 * rng.normal(size=(240, 16)))
    cells = ann.CentroidCells(centres / np.linalg.norm(centres, axis=1)[:, None])
    path = str(tmp_path / "cells")
    ann.write_cells(rows, cells, path)
    asked = queries(spark, centres[:2]).select("query_id", "embedding")
    plan = ann.probed_rows(path, cells.assign(asked, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    found = ann.stored_search(path, asked, cells, 10, 2)
    same(collected(found), collected(ann.approximate_search(rows, asked, cells, 10, 2)))
