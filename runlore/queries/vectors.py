"""Queries over exact and approximate vector search."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.functions import vector as vc
from runlore.operators import ann, search as se
from runlore.queries.base import cosine_sql, query, table
from runlore.session import scratch_path

K = 10
#: Cells, and how many are probed for a recall of 0.9 or more: of the centroid cells, and in each table of projections.
CELLS, CENTROID_PROBES, PROJECTION_PROBES = 16, 10, 2
_OUT = "query_id, vec_id, round(s, 4) AS score, rank"


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings")


def as_queries(spark, sf, filter_col=None) -> DataFrame:
    """Every vector as a query, with its label as the filter when asked for."""
    rows = vectors(spark, sf)
    f = [filter_col.alias("f_label")] if filter_col is not None else []
    return rows.select(F.col("vec_id").alias("query_id"), "embedding", *f)


def _out(found: DataFrame) -> DataFrame:
    return found.select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


@query("vector_topk", f"WITH {cosine_sql(K)} SELECT {_OUT} FROM found")
def vector_topk(spark, sf):
    return _out(se.search(vectors(spark, sf), as_queries(spark, sf), K, id_col="vec_id"))


@query(
    "vector_topk_small_index",
    """SELECT vec_id AS query_id, (SELECT count(*) FROM embeddings WHERE label = 3) AS of_few, 0::BIGINT AS of_none FROM embeddings""",
)
def vector_topk_small_index(spark, sf):
    """More neighbours are asked for than the index has rows, and any from an index without rows."""
    asked, rows = as_queries(spark, sf), vectors(spark, sf)
    few = se.search(rows.where(F.col("label") == 3), asked, 1_000_000, id_col="vec_id").groupBy("query_id").agg(F.count("*").alias("of_few"))
    none = se.search(rows.where(F.col("label") < 0), asked, K, id_col="vec_id").groupBy("query_id").agg(F.count("*").alias("of_none"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return asked.select("query_id").join(few, "query_id", "left").join(none, "query_id", "left").select("query_id", zero("of_few"), zero("of_none"))


@query("vector_topk_grid", f"WITH {cosine_sql(K)} SELECT {_OUT} FROM found")
def vector_topk_grid(spark, sf):
    """The way for query sets too large to broadcast at once: rounds of blocks."""
    return _out(se.search(vectors(spark, sf), as_queries(spark, sf), K, id_col="vec_id", broadcast_bytes=256 << 10))


@query(
    "vector_topk_ip",
    f"WITH {cosine_sql(K, score='list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])')} SELECT {_OUT} FROM found",
)
def vector_topk_ip(spark, sf):
    return _out(se.search(vectors(spark, sf), as_queries(spark, sf), K, metric="ip", id_col="vec_id"))


@query(
    "vector_topk_l2",
    f"WITH {cosine_sql(K, score='-(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2)')} SELECT {_OUT} FROM found",
)
def vector_topk_l2(spark, sf):
    return _out(se.search(vectors(spark, sf), as_queries(spark, sf), K, metric="l2", id_col="vec_id"))


_POST = f"""WITH {cosine_sql(3 * K)},
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM found WHERE lb = la)
SELECT query_id, vec_id, round(s, 4) AS score, r AS rank FROM kept WHERE r <= {K}"""


@query("vector_topk_post_filter", _POST)
def vector_topk_post_filter(spark, sf):
    """Three times k, filtered by label, first k: some queries get fewer."""
    return _out(se.search(vectors(spark, sf), as_queries(spark, sf, F.col("label")), K, "post", id_col="vec_id"))


@query("vector_topk_pre_filter", f"WITH {cosine_sql(K, 'a.label = b.label')} SELECT {_OUT} FROM found")
def vector_topk_pre_filter(spark, sf):
    return _out(se.search(vectors(spark, sf), as_queries(spark, sf, F.col("label")), K, id_col="vec_id"))


@query(
    "vector_topk_list_filter",
    f"WITH {cosine_sql(K, 'b.label IN (a.label, (a.label + 1) % 10)')} SELECT {_OUT} FROM found",
)
def vector_topk_list_filter(spark, sf):
    two = F.array("label", (F.col("label") + 1) % 10)
    return _out(se.search(vectors(spark, sf), as_queries(spark, sf, two), K, id_col="vec_id"))


@query(
    "vector_topk_null_filter",
    f"""WITH scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
      FROM embeddings a, (SELECT vec_id, embedding, nullif(label, 3) AS label FROM embeddings) b
      WHERE a.label = 5 OR CASE WHEN a.label = 4 THEN b.label IS NULL OR b.label = 4 ELSE b.label = a.label END),
    found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM scored)
    SELECT {_OUT} FROM found WHERE rank <= {K}""",
)
def vector_topk_null_filter(spark, sf):
    """Label 3 is missing on the rows: its queries find nothing, a list that holds a null finds the missing ones, and
    queries of label 5 come without a filter."""
    rows = vectors(spark, sf).withColumn("label", F.nullif("label", F.lit(3)))
    wanted = F.when(F.col("label") == 4, F.array(F.lit(4), F.lit(None))).when(F.col("label") != 5, F.array("label"))
    return _out(se.search(rows, as_queries(spark, sf, wanted), K, id_col="vec_id"))


def label_centroids(spark, sf) -> DataFrame:
    """The mean vector of each label as a query: one row per label, built by one aggregation over all vectors."""
    rows = vectors(spark, sf).select("label", array_to_vector("embedding").alias("v"))
    means = rows.groupBy("label").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("embedding"))
    return means.select(F.col("label").cast("bigint").alias("query_id"), "embedding", F.col("label").alias("f_label"))


_CENTROIDS = """c AS (SELECT label, list(m ORDER BY pos) AS v FROM (
    SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY label)"""


@query(
    "label_centroid_topk",
    f"""WITH {_CENTROIDS}, scored AS (SELECT CAST(c.label AS BIGINT) AS query_id, b.vec_id, b.label AS lb, c.label AS la,
      list_cosine_similarity(c.v, b.embedding::DOUBLE[]) AS s FROM c, embeddings b WHERE c.label = b.label),
    kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM scored)
    SELECT query_id, vec_id, round(s, 4) AS score, rank FROM kept WHERE rank <= {K}""",
)
def label_centroid_topk(spark, sf):
    return _out(se.search(vectors(spark, sf), label_centroids(spark, sf), K, id_col="vec_id"))


@query(
    "normalised_vectors",
    """SELECT vec_id, pos, round(x * 3 / (3 * sqrt(q)), 5) AS x FROM (
        SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos,
          list_sum(list_transform(embedding::DOUBLE[], lambda e: e * e)) AS q FROM embeddings)""",
)
def normalised_vectors(spark, sf):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    rows = vectors(spark, sf).select("vec_id", vc.normalise(tripled).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query("vector_dimensions", "SELECT count(*) AS vectors, min(len(embedding)) AS min_dimensions, max(len(embedding)) AS max_dimensions, bool_and(len(embedding) = 64) AS ok FROM embeddings")
def vector_dimensions(spark, sf):
    return se.check_dimensions(vectors(spark, sf), 64)


_CELLS = f"""WITH {_CENTROIDS}, near AS (SELECT vec_id, label AS cell, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS place
    FROM (SELECT e.vec_id, c.label, round(list_inner_product(c.v, c.v) - 2 * list_inner_product(e.embedding::DOUBLE[], c.v)
      / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 12) AS d FROM embeddings e, c)),
  met AS (SELECT DISTINCT a.vec_id AS query_id, b.vec_id FROM near a JOIN near b ON a.cell = b.cell WHERE a.place <= 3 AND b.place = 1),
  scored AS (SELECT query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
    FROM met JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = met.vec_id),
  found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM scored)"""


@query("vector_topk_centroid_cells", f"{_CELLS} SELECT {_OUT} FROM found WHERE rank <= {K}")
def vector_topk_centroid_cells(spark, sf):
    """Cells around the mean vector of each label, written as folders; the three nearest are read."""
    rows = vectors(spark, sf)
    means = label_centroids(spark, sf).orderBy("query_id").collect()  # as many as labels
    cells = ann.CentroidCells(np.array([r.embedding for r in means]))
    path = scratch_path(spark, "cells")
    ann.write_cells(rows, cells, path, "vec_id")
    return _out(ann.stored_search(path, as_queries(spark, sf), cells, K, probes=3, id_col="vec_id"))


@query("vector_topk_centroid_cells_all", f"WITH {cosine_sql(K)} SELECT {_OUT} FROM found")
def vector_topk_centroid_cells_all(spark, sf):
    """Probing every cell is the exact search again, whatever the cells are."""
    rows = vectors(spark, sf)
    cells = ann.CentroidCells.fit(rows, 8)
    return _out(ann.approximate_search(rows, as_queries(spark, sf), cells, K, probes=8, id_col="vec_id"))


@query("vector_topk_projection_cells")
def vector_topk_projection_cells(spark, sf):
    rows = vectors(spark, sf)
    cells = ann.ProjectionCells.fit(rows)
    return _out(ann.approximate_search(rows, as_queries(spark, sf), cells, K, probes=PROJECTION_PROBES, id_col="vec_id"))


@query("approximate_recall")
def approximate_recall(spark, sf):
    """Share of the exact top ten found by each kind of cell."""
    rows, wanted = vectors(spark, sf), as_queries(spark, sf)
    exact = se.search(rows, wanted, K, id_col="vec_id")
    means = label_centroids(spark, sf).orderBy("query_id").collect()  # as many as labels
    kinds = {
        "centroids": (ann.CentroidCells.fit(rows, CELLS), CENTROID_PROBES),
        "projections": (ann.ProjectionCells.fit(rows), PROJECTION_PROBES),
        "labels": (ann.CentroidCells(np.array([r.embedding for r in means])), 3),
    }
    parts = [
        ann.recall(ann.approximate_search(rows, wanted, cells, K, probes, "vec_id"), exact, "vec_id").withColumn("cells", F.lit(name))
        for name, (cells, probes) in kinds.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
