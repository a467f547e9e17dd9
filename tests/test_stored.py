"""Stored indexes against the searches that read everything: postings, blocks of vectors, codes, and partitioned chunks."""

import os
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlore.operators import blocks, lexical, lookup, postings, search as se, vector_blocks
from runlore.operators.centroids import k_means, nearest
from runlore.operators.partitioned_table import PartitionedTable, filter_rows, may_be_known
from runlore.operators.quantised import Codes, search_coded, write_coded
from runlore.operators.vector_blocks import block_bounds, open_blocks, search_blocks, write_blocks

# postings


def corpus(spark, n=300, seed=2):
    rng = random.Random(seed)
    words = ["the"] * 30 + [f"w{i}" for i in range(60)]
    rows = [(f"c{i:04d}", " ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["a", "b", None])) for i in range(n)]
    rows += [(f"d{i:04d}", t, s) for i, (_, t, s) in enumerate(rows[:40])] + [("e", None, "a"), ("f", "", "b"), ("g", "THE the W1 only-here", "a")]
    asked = [(i, " ".join(rng.choices(words, k=6)), rng.choice(["a", "b", None])) for i in range(12)]
    asked += [(20, "nothing known", None), (21, "", None), (22, "only here the", None), (23, "the", "a")]
    return (spark.createDataFrame(rows, "chunk_id string, text string, source string").repartition(5),
            spark.createDataFrame(asked, "query_id int, text string, f_source string"))


def same(found, wanted, *ids):
    columns = ["query_id", *ids, "score", "rank"]
    got, want = (sorted(tuple(r[c] for c in columns) for r in df.collect()) for df in (found, wanted))
    assert got == want and got


@pytest.mark.parametrize(("limit", "block"), [(1 << 30, 7), (1500, 1024)])
def test_postings_find_what_a_scan_finds(spark, tmp_path, block, limit):
    rows, asked = corpus(spark)
    queries = asked.drop("f_source")
    postings.append(spark, str(tmp_path), rows.where("chunk_id < 'c0100'"), carry=("source",), block_texts=block, buckets=4)
    index = postings.append(spark, str(tmp_path), rows.where("chunk_id >= 'c0100'"), carry=("source",), block_texts=block, buckets=4)
    assert len(index.segments) == 2 and index.texts == rows.count()
    same(postings.search(index, queries, 8, broadcast_bytes=limit), lexical.bm25(rows, queries, 8), "chunk_id")
    filtered = postings.search(index, asked, 5, filter_keys=("source",))
    same(filtered, lexical.bm25(rows, asked, 5, filter_keys=("source",), carry=("source",)), "chunk_id", "source")
    same(postings.search(index, asked, 5, ("source",), True), lexical.bm25(rows, asked, 5, filter_keys=("source",), missing_passes=True), "chunk_id")


def test_a_search_reads_folders_of_its_terms(spark, tmp_path):
    rows, _ = corpus(spark)
    index = postings.append(spark, str(tmp_path), rows, block_texts=16, buckets=8)
    one = index.postings(spark.createDataFrame([("the",)], "term string"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert one.count() > 10 and one.select("bucket").distinct().count() == 1  # a hot term is many rows
    assert {r.term for r in one.collect()} == {"the"}


def test_blocks_that_cannot_matter_are_left_out(spark, tmp_path):
    rows = spark.range(2000).select(F.format_string("c%05d", "id").alias("chunk_id"),
                                    F.when(F.col("id") % 200 < 3, F.lit("rare rare rare")).otherwise(F.lit("common word rare and more to say here")).alias("text"))
    index = postings.append(spark, str(tmp_path), rows.where("id < 500 OR id >= 500"), block_texts=10, buckets=2)
    asked = spark.createDataFrame([(1, "rare")], "query_id int, text string")
    report = postings.block_report(index, asked, 5).first()
    assert report.scored < 40 < report.pairs == 200
    same(postings.search(index, asked, 5), lexical.bm25(rows, asked, 5), "chunk_id")


def test_postings_of_nothing(spark, tmp_path):
    rows, asked = corpus(spark)
    empty = postings.append(spark, str(tmp_path / "a"), rows.limit(0), buckets=2)
    assert empty.texts == 0 and postings.search(empty, asked).count() == 0
    index = postings.append(spark, str(tmp_path / "b"), rows, buckets=2)
    assert postings.search(index, asked.limit(0)).count() == 0
    assert postings.search(index, asked.where("query_id = 20")).count() == 0
    with pytest.raises(ValueError, match="doesn't carry"):
        postings.search(index, asked, filter_keys=("source",))


def test_a_segment_half_written_is_not_read(spark, tmp_path):
    rows, asked = corpus(spark)
    index = postings.append(spark, str(tmp_path), rows, buckets=2)
    (tmp_path / "blocks" / "segment=half").mkdir()
    (tmp_path / "postings" / "segment=half").mkdir()
    assert postings.open_index(spark, str(tmp_path)).segments == index.segments
    same(postings.search(postings.open_index(spark, str(tmp_path)), asked, 3), lexical.bm25(rows, asked, 3), "chunk_id")


# vectors in blocks


def vectors(spark, n=600, width=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width)) * 3
    rows = [(i, (centres[i % 12] + rng.standard_normal(width) * 0.4).tolist(), "ab"[i % 2] if i % 5 else None) for i in range(n)]
    rows += [(n + i, rows[i][1], "a") for i in range(20)] + [(n + 50, [0.0] * width, "b"), (n + 51, None, "a")]
    return spark.createDataFrame(rows, "vec_id int, embedding array<float>, kind string").repartition(4)


def as_queries(rows):
    return rows.where("vec_id % 7 = 0 OR vec_id >= 600").select(F.col("vec_id").alias("query_id"), "embedding", F.col("kind").alias("f_kind"))


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_blocks_give_the_exact_search(spark, tmp_path, metric):
    rows = vectors(spark)
    queries = as_queries(rows)
    write_blocks(rows, str(tmp_path), metric, "vec_id", ("kind",), cells=12, block_rows=16)
    table = open_blocks(spark, str(tmp_path))
    plain, blocks = search_blocks(table, queries.drop("f_kind"), 6)
    same(plain, se.search(rows, queries.drop("f_kind"), 6, metric=metric, id_col="vec_id"), "vec_id")
    heads = table.heads().count()
    asked = blocks.agg(F.sum(F.size("asked"))).first()[0]
    assert metric == "ip" or asked < 0.5 * heads * queries.count()
    found, _ = search_blocks(table, queries, 6)
    same(found, se.search(rows, queries, 6, metric=metric, id_col="vec_id"), "vec_id", "kind")
    found, _ = search_blocks(table, queries, 6, missing_passes=True, broadcast_bytes=2000)
    same(found, se.search(rows, queries, 6, metric=metric, id_col="vec_id", missing_passes=True), "vec_id")


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_bounds_hold(metric):
    rng = np.random.default_rng(4)
    for _ in range(50):
        m, q = rng.standard_normal((20, 5)) * rng.uniform(0.1, 3), rng.standard_normal((9, 5))
        if metric == "cosine":
            m, q = (x / np.linalg.norm(x, axis=1)[:, None] for x in (m, q))
        centre = m.mean(0)
        radius = np.linalg.norm(m - centre, axis=1).max()
        limit = block_bounds(q, metric, centre[None], np.array([radius]), np.array([metric == "cosine"]))[:, 0]
        scores = -((q[:, None] - m[None]) ** 2).sum(2) if metric == "l2" else q @ m.T
        assert (scores.max(1) <= limit + 1e-8).all()


def test_blocks_of_nothing(spark, tmp_path):
    rows = vectors(spark)
    table = write_blocks(rows.limit(0), str(tmp_path / "a"), id_col="vec_id")
    assert search_blocks(table, as_queries(rows).drop("f_kind"))[0].count() == 0
    table = write_blocks(rows, str(tmp_path / "b"), id_col="vec_id")
    assert search_blocks(table, as_queries(rows).drop("f_kind").limit(0))[0].count() == 0
    with pytest.raises(ValueError, match="nothing to filter by"):
        search_blocks(table, as_queries(rows))


def test_centres_of_few_points():
    points = np.array([[0.0, 0], [0, 0], [5, 5], [5, 5.1]])
    assert len(k_means(points, 10)) == 3 and k_means(np.zeros((0, 2)), 3).shape == (0, 2)
    two = k_means(points, 2)
    assert sorted(np.bincount(nearest(points, two)[:, 0]).tolist()) == [2, 2]


# codes


def test_codes_find_the_near_ones(spark, tmp_path):
    rows = vectors(spark, 900, 16)
    queries = as_queries(rows)
    codes = Codes.fit(rows, 12, 8, "vec_id")
    table = write_coded(rows, str(tmp_path), codes, "vec_id", ("kind",))
    assert {f.name for f in table.coded().schema} == {"vec_id", "kind", "code", "cell"} and len(table.coded().first().code) == 8
    exact = {(r.query_id, r.vec_id): r.score for r in se.search(rows, queries.drop("f_kind"), 5, id_col="vec_id").collect()}
    got = {(r.query_id, r.vec_id): r.score for r in search_coded(table, queries.drop("f_kind"), 5, probes=4).collect()}
    assert len(set(got) & set(exact)) >= 0.95 * len(exact)
    assert all(got[p] == exact[p] for p in set(got) & set(exact))
    all_of_it = search_coded(table, queries, 5, probes=12, survivors=400)
    same(all_of_it, se.search(rows, queries, 5, id_col="vec_id"), "vec_id", "kind")
    with pytest.raises(ValueError, match="parts"):
        Codes.fit(rows, 4, 17, "vec_id")


# partitions


SCHEMA = "chunk_id string, document_id string, content_hash string, text string"


def chunks(spark, rows):
    return spark.createDataFrame([(f"{d}_{c}", d, h, f"text {h}") for d, c, h in rows], SCHEMA)


def content(table):
    return sorted((r.chunk_id, r.content_hash) for r in table.read().collect())


def files_of(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("rows/part=*/*.parquet")}


def test_an_addition_reads_what_it_touches(spark, tmp_path):
    rows = [(f"doc{i}", c, f"h{i}{c}") for i in range(60) for c in range(3)]
    table = PartitionedTable(spark, str(tmp_path), chunks(spark, []).schema, partitions=8)
    assert content(table) == [] and table.add(chunks(spark, rows)) == {"added": 180, "replaced": 0}
    before = files_of(tmp_path)
    assert table.add(chunks(spark, rows[:50])) == {"added": 0, "replaced": 0} and files_of(tmp_path) == before
    new = chunks(spark, [("doc7", 9, "x"), ("doc7", 9, "w"), ("doc7", 1, "other")])
    assert table.add(new) == {"added": 1, "replaced": 0}
    assert {p.parent for p in files_of(tmp_path)} >= {p.parent for p in before}
    assert len({p.parent.name for p in set(files_of(tmp_path)) - set(before)}) == 1  # of one partition
    assert content(table) == sorted([(f"{d}_{c}", h) for d, c, h in rows] + [("doc7_9", "w")])
    parts = table.parts_of(new.withColumn("part", table.part()))
    assert len(parts) == 1
    plan = table.read(parts)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan)


def test_unknown_ids_need_no_rows(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path), chunks(spark, []).schema, partitions=4)
    table.add(chunks(spark, [(f"doc{i}", 0, f"h{i}") for i in range(500)]))
    fresh = chunks(spark, [(f"new{i}", 0, "h") for i in range(500)]).withColumn("part", table.part())
    assert may_be_known(fresh.select("part", "chunk_id"), table.filters()).count() == 0
    old = table.read().withColumn("part", table.part()).select("part", "chunk_id")
    assert may_be_known(old, table.filters()).count() == 500  # never a false no
    assert may_be_known(fresh, filter_rows(fresh.limit(0))).count() == 0


def test_a_correction_rewrites_its_partition(spark, tmp_path):
    rows = [(f"doc{i}", c, f"h{i}{c}") for i in range(40) for c in range(2)]
    table = PartitionedTable(spark, str(tmp_path), chunks(spark, []).schema, partitions=8)
    table.add(chunks(spark, rows))
    before = files_of(tmp_path)
    assert table.add(chunks(spark, [("doc3", 0, "corrected"), ("doc3", 1, "h31"), ("doc99", 0, "n")]), "replace") == {"added": 1, "replaced": 1}
    want = {(f"{d}_{c}", h) for d, c, h in rows} - {("doc3_0", "h30")} | {("doc3_0", "corrected"), ("doc99_0", "n")}
    assert content(table) == sorted(want)
    after = files_of(tmp_path)
    gone = {p.parent.name for p in set(before) - set(after)}
    assert len(gone) == 1 and all(after[p] == before[p] for p in set(before) & set(after))
    with pytest.raises(ValueError, match="on_change"):
        table.add(chunks(spark, []), "merge")


def test_partitions_are_compacted_and_versions_switched(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path), chunks(spark, []).schema, partitions=2)
    for i in range(6):
        table.add(chunks(spark, [(f"doc{i}-{j}", 0, "h") for j in range(20)]))
    want, n = content(table), len(files_of(tmp_path))
    assert sorted(table.compact(5)) == [0, 1] and content(table) == want and len(files_of(tmp_path)) < n
    assert table.compact(5) == []
    old = table.version()
    table.rebuild(chunks(spark, [("d", 0, "h")]))
    assert content(table) == [("d_0", "h")] and table.version() != old
    with pytest.raises(ValueError, match="without id"):
        table.rebuild(chunks(spark, [("d", 0, "h")]).withColumn("chunk_id", F.lit(None).cast("string")))
    assert content(table) == [("d_0", "h")] and not [f for f in os.listdir(tmp_path) if f.startswith("_")]


# lookup by id


def test_ids_are_looked_up_in_their_buckets(spark, tmp_path):
    rows = spark.range(5000).select(F.format_string("c%05d", "id").alias("chunk_id"), F.concat(F.lit("text "), "id").alias("text"))
    stored = lookup.write_bucketed(rows, str(tmp_path), buckets=8)
    again = lookup.open_bucketed(spark, str(tmp_path), rows.schema, 8)
    few = spark.createDataFrame([(1, "c00007"), (2, "c00007"), (3, "none"), (4, None)], "q int, chunk_id string")
    for table in (stored, again):
        found = lookup.looked_up(few, table, ["text"])
        assert sorted((r.q, r.text) for r in found.collect()) == [(1, "text 7"), (2, "text 7")]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [In(chunk_id, [c00007,none])" in plan  # so two of eight buckets at most


def test_many_ids_leave_the_table_in_place(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).select(F.format_string("c%05d", "id").alias("chunk_id"), F.col("id").alias("v"))
    table = lookup.write_bucketed(rows, str(tmp_path), buckets=8)
    found = spark.range(9000).select(F.col("id").alias("q"), F.format_string("c%05d", F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 4000)).alias("chunk_id"))
    want = sorted((r.q, r.v) for r in found.join(rows, "chunk_id").collect())
    met = lookup.looked_up(found, table, ["v"])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert sorted((r.q, r.v) for r in met.collect()) == want
    monkeypatch.setattr(lookup, "HOT_ROWS", 100)
    apart = lookup.looked_up(found, table, ["v"])
    assert "BroadcastHashJoin" in apart._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.q, r.v) for r in apart.collect()) == want


def test_blocks_that_all_queries_need(spark, tmp_path, monkeypatch):
    """Where bounds leave out nothing: a bit for each query of a block, and rows are scored with those of their label only."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(rng.standard_normal((480, 24)))], "vec_id int, embedding array<double>, kind int")
    queries = rows.select(F.col("vec_id").alias("query_id"), "embedding", F.col("kind").alias("f_kind"))
    table = write_blocks(rows, str(tmp_path), id_col="vec_id", carry=("kind",), cells=3, block_rows=32)
    sizes, materialise = [], blocks.materialise
    monkeypatch.setattr(blocks, "materialise", lambda df: sizes.append(materialise(df)) or sizes[-1])
    monkeypatch.setattr(blocks, "BOUND_CELLS", 960)
    found, asked = search_blocks(table, queries, 5)
    same(found, se.search(rows, queries, 5, id_col="vec_id"), "vec_id", "kind")
    bits = {len(r.asked) for r in sizes[-1].collect()}
    assert bits == {480 // 8}  # not a number of eight bytes for each
    assert asked.agg(F.sum(F.size("asked"))).first()[0] > 0.9 * 480 * table.heads().count()


def test_blocks_go_together_if_queries_ask_for_both():
    flat = [float(x) for x in range(8)]

    def rows(*asked):
        return [pa.RecordBatch.from_pydict({"asked": pa.array(asked, pa.list_(pa.int64())), "flat": pa.array([flat] * len(asked)), "vec_id": pa.array([[1, 2, 3, 4]] * len(asked))})]

    def sizes(*asked):
        return [(r.num_rows, np.flatnonzero(need).tolist()) for r, need in vector_blocks._together(iter(rows(*asked)), 6, ["vec_id"], [pa.int64()])]

    assert sizes([0, 1, 2], [0, 1, 3], [5]) == [(8, [0, 1, 2, 3]), (4, [5])]
    assert sizes([0, 1], [2, 3], [4, 5]) == [(8, [0, 1, 2, 3]), (4, [4, 5])]
