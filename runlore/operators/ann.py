"""Approximate nearest neighbours by cells: only the cells near a query are searched.

Cells are nearest k-means centroids or hash buckets of random projections. Within the probed cells the search is exact
and runs on bounded blocks, so a cell with a third of all vectors is many tasks rather than one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.functions import vector as vc
from runlore.operators.topk import BROADCAST_BYTES, DenseScorer, best_per_query, grid_candidates
from runlore.session import materialise


def _unit(df: DataFrame) -> DataFrame:
    return df.where(F.col("embedding").isNotNull()).withColumn("embedding", vc.normalise(F.col("embedding")))


@dataclass(frozen=True)
class CentroidCells:
    """Cells of the nearest centroid. Their number is a parameter, so the centroids are small enough to ship."""

    centroids: np.ndarray

    @classmethod
    def fit(cls, vectors: DataFrame, n_cells: int, seed: int = 7, max_iter: int = 10) -> CentroidCells:
        points = _unit(vectors).select(array_to_vector("embedding").alias("features"))
        model = KMeans(k=n_cells, seed=seed, maxIter=max_iter).fit(points)
        centroids = np.asarray(model.clusterCenters())
        if centroids.nbytes > BROADCAST_BYTES:
            raise ValueError(f"{len(centroids)} centroids are too large to ship; ask for fewer cells")
        return cls(centroids)

    def assign(self, df: DataFrame, probes: int = 1) -> DataFrame:
        """One row per vector and each of its ``probes`` nearest cells."""
        shared = df.sparkSession.sparkContext.broadcast(self.centroids)

        @F.pandas_udf("array<int>")
        def nearest(vectors: pd.Series) -> pd.Series:
            centroids = shared.value
            if not len(vectors):
                return pd.Series([], dtype=object)
            points = np.stack(vectors.to_numpy()).astype(np.float64)
            distance = (centroids**2).sum(axis=1)[None, :] - 2 * points @ centroids.T
            return pd.Series(list(np.argsort(distance, axis=1, kind="stable")[:, :probes].astype(np.int32)))

        # Outer, so that the optimizer does not filter by a second call of the function.
        cells = _unit(df).withColumn("cell", F.explode_outer(nearest("embedding")))
        return cells.where(F.col("cell").isNotNull())


@dataclass(frozen=True)
class ProjectionCells:
    """Hash buckets of several random projections; a vector is in one bucket of each table. On unit vectors the
    buckets per table are at most ``2 / bucket_length + 1``."""

    model: BucketedRandomProjectionLSHModel

    @classmethod
    def fit(cls, vectors: DataFrame, tables: int = 4, bucket_length: float = 0.1, seed: int = 7) -> ProjectionCells:
        lsh = BucketedRandomProjectionLSH(
            inputCol="features", outputCol="hashes", numHashTables=tables, bucketLength=bucket_length, seed=seed
        )
        return cls(lsh.fit(_unit(vectors).withColumn("features", array_to_vector("embedding"))))

    def assign(self, df: DataFrame, probes: int = 1) -> DataFrame:
        """One row per vector, table and each of the ``probes`` buckets around its own."""
        hashed = self.model.transform(_unit(df).withColumn("features", array_to_vector("embedding"))).drop("features")
        rows = hashed.select("*", F.posexplode_outer("hashes").alias("_table", "_hash")).drop("hashes")
        bucket = F.element_at(vector_to_array("_hash"), 1).cast("int")
        # Own bucket first, then its neighbours outwards.
        offsets = [(i + 1) // 2 * (1 if i % 2 else -1) for i in range(probes)]
        near = F.explode(F.array(*[bucket + o for o in offsets]))
        cell = F.concat_ws(":", "_table", "_bucket")
        return rows.withColumn("_bucket", near).withColumn("cell", cell).drop("_table", "_hash", "_bucket")


def approximate_search(
    vectors: DataFrame, queries: DataFrame, cells: CentroidCells | ProjectionCells, k: int = 10, probes: int = 4,
    id_col: str = "chunk_id",
) -> DataFrame:
    """(query_id, id, score, rank) like the exact search, from the probed cells only."""
    rows = cells.assign(vectors.select(id_col, "embedding"))
    wanted = cells.assign(queries.select("query_id", "embedding"), probes)
    found = grid_candidates(rows, wanted, partial(DenseScorer, metric="cosine"), k, [id_col], cell="cell")
    # A row can be found through more than one cell; its score is the same each time.
    distinct = found.groupBy("query_id", id_col).agg(F.max("score").alias("score"))
    return best_per_query(distinct, id_col, k).select("query_id", id_col, "score", "rank")


def write_cells(vectors: DataFrame, cells: CentroidCells | ProjectionCells, path: str, id_col: str = "chunk_id") -> None:
    """The vectors with their cells, a folder a cell, written once when an index is built. A hot cell is many files."""
    rows = cells.assign(vectors.select(id_col, "embedding"))
    rows.write.partitionBy("cell").parquet(path)


def stored_search(
    path: str, queries: DataFrame, cells: CentroidCells | ProjectionCells, k: int = 10, probes: int = 4, id_col: str = "chunk_id",
) -> DataFrame:
    """The search over written cells: only the folders of probed cells are read, and no vector is assigned again."""
    wanted = materialise(cells.assign(queries.select("query_id", "embedding"), probes))
    found = grid_candidates(probed_rows(path, wanted), wanted, partial(DenseScorer, metric="cosine"), k, [id_col], cell="cell")
    distinct = found.groupBy("query_id", id_col).agg(F.max("score").alias("score"))
    return best_per_query(distinct, id_col, k).select("query_id", id_col, "score", "rank")


def probed_rows(path: str, wanted: DataFrame) -> DataFrame:
    """Rows of the cells that the queries probe; as many values as cells at most go to the scan's partition filter."""
    probed = [r.cell for r in wanted.select("cell").distinct().collect()]
    return wanted.sparkSession.read.parquet(path).where(F.col("cell").isin(probed))


def recall(approximate: DataFrame, exact: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """One row: share of the exact results that the approximate search found."""
    hits = exact.select("query_id", id_col).join(
        approximate.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left"
    )
    return hits.agg(F.count("*").alias("expected"), F.count("hit").alias("found")).withColumn(
        "recall", F.try_divide("found", "expected")
    )
