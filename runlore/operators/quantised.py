"""Approximate search over product-quantised vectors in cells.

A vector is stored as its nearest centroid, its cell, and for each stretch of its dimensions the number of the nearest
entry of a code book to what the centroid leaves. A search reads the packed codes of the cells that its queries probe:
an eighth to a sixteenth of the vectors' bytes. The best by these approximate scores are then scored exactly from the
vectors themselves, which lie apart and in the same folders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.operators.centroids import k_means, nearest, sample, unit
from runlore.operators.search import filter_columns
from runlore.operators.skew import join_hot
from runlore.operators.topk import BROADCAST_BYTES, DenseScorer, best_per_query, list_matrix, table_bytes, topk
from runlore.operators.vector_blocks import spread_cells
from runlore.session import materialise

#: Entries of a code book; a code is one byte.
ENTRIES = 256


@dataclass(frozen=True)
class Codes:
    """Centroids of the cells and a code book per stretch of dimensions, of unit vectors."""

    centres: np.ndarray
    books: tuple[np.ndarray, ...]

    @classmethod
    def fit(cls, vectors: DataFrame, cells: int, parts: int, id_col: str = "chunk_id", rows: int | None = None) -> Codes:
        """From a bounded sample. ``parts``: bytes of a code, at most as many as dimensions."""
        points = sample(vectors, id_col, **({"rows": rows} if rows else {}))
        if not len(points):
            raise ValueError("no vectors to fit codes to")
        if not 1 <= parts <= points.shape[1]:
            raise ValueError(f"{parts} parts of {points.shape[1]} dimensions")
        centres = k_means(points, cells)
        rest = points - centres[nearest(points, centres)[:, 0]]
        return cls(centres, tuple(k_means(np.ascontiguousarray(x), ENTRIES) for x in np.array_split(rest, parts, axis=1)))

    def encode(self, m: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Codes of unit rows, a byte per stretch."""
        stretches = np.array_split(m - self.centres[cell], len(self.books), axis=1)
        return np.stack([nearest(np.ascontiguousarray(x), b)[:, 0] for x, b in zip(stretches, self.books, strict=True)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)


class CodeScorer(DenseScorer):
    """Cosine of queries and what the codes of rows stand for: a batch is decoded once, for all queries."""

    def __init__(self, queries: pa.Table, codes: Codes):
        super().__init__(queries, "cosine")
        self.codes = codes

    def prepare(self, batch):
        packed = batch.column("code")
        codes = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
        rows = self.codes.decode(codes, batch.column("cell").to_numpy())
        return rows, rows.astype(np.float32), self._reach(rows)


@dataclass(frozen=True)
class CodedTable:
    spark: SparkSession
    root: str
    codes: Codes
    id_col: str
    carry: tuple[str, ...]

    def coded(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/codes")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/vectors")


def write_coded(vectors: DataFrame, path: str, codes: Codes, id_col: str = "chunk_id", carry: tuple[str, ...] = ()) -> CodedTable:
    """Code every vector and write codes and vectors, a folder a cell each. Rows without a vector are left out."""
    spark, path, payload = vectors.sparkSession, path.rstrip("/"), list(dict.fromkeys([id_col, *carry]))
    shared = spark.sparkContext.broadcast(codes)
    rows = materialise(spread_cells(vectors, codes.centres, payload))
    schema = T.StructType([*[rows.schema[c] for c in ("cell", *payload)], T.StructField("code", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = shared.value.encode(unit(list_matrix(batch.column("embedding"))), batch.column("cell").to_numpy())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in schema.names[:-1]], pa.array([x.tobytes() for x in packed], pa.binary())], names=schema.names)

    rows.mapInArrow(run, schema).write.partitionBy("cell").parquet(f"{path}/codes")
    rows.select("cell", id_col, "embedding").write.partitionBy("cell").parquet(f"{path}/vectors")
    return CodedTable(spark, path, codes, id_col, tuple(payload[1:]))


def search_coded(table: CodedTable, queries: DataFrame, k: int = 10, probes: int = 4, survivors: int = 10, missing_passes: bool = False,
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, id, *carry, score, rank) like the exact search by cosine, of the probed cells: the ``survivors`` * k best
    by their codes are scored exactly. Only the folders of probed cells are read.

    ``queries``: query_id, embedding and filter columns ``f_<key>`` of carried columns, which come before the cut.
    """
    id_col, shared = table.id_col, table.spark.sparkContext.broadcast(table.codes)
    keys = filter_columns(queries, table.coded())
    probes = min(probes, len(table.codes.centres))
    wanted = queries.where(F.col("embedding").isNotNull()).select("query_id", *[f"f_{c}" for c in keys], "embedding")
    schema = T.StructType([*wanted.schema.fields, T.StructField("f_cell", T.ArrayType(T.IntegerType()))])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest(unit(list_matrix(batch.column("embedding"))), shared.value.centres, probes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, probes), pa.int32()), pa.array(near.reshape(-1), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names)

    wanted = materialise(wanted.mapInArrow(probed, schema))
    cells = [r.cell for r in wanted.select(F.explode("f_cell").alias("cell")).distinct().collect()]  # folders to read
    rows = table.coded().where(F.col("cell").isin(cells)).select(id_col, *table.carry, "cell", "code")
    scorer = partial(CodeScorer, codes=table.codes)
    near = topk(rows, wanted, scorer, k * survivors, [id_col, *table.carry, "cell"], ("cell", *keys), missing_passes, broadcast_bytes=broadcast_bytes)
    near = materialise(near.drop("score", "rank"))
    vectors = table.vectors().where(F.col("cell").isin(cells)).drop("cell")
    asked = wanted.select("query_id", F.col("embedding").alias("_query"))
    ids = near.select(id_col).distinct()
    few = table_bytes(near)[1] <= broadcast_bytes
    met = near.join(vectors.join(F.broadcast(ids) if few else ids, id_col, "left_semi"), id_col) if few else join_hot(near, vectors, id_col)
    met = met.join(F.broadcast(asked), "query_id") if table_bytes(asked)[1] <= broadcast_bytes else met.join(asked, "query_id")
    kinds = {f.name: f.dataType for f in met.schema.fields}
    out = T.StructType([T.StructField(c, kinds[c]) for c in ("query_id", id_col, *table.carry)] + [T.StructField("score", T.DoubleType())])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = unit(list_matrix(batch.column("_query"))), unit(list_matrix(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out.names[:-1]], pa.array((a * b).sum(axis=1))], names=out.names)

    scored = met.select("query_id", id_col, *table.carry, "_query", "embedding").mapInArrow(exact, out)
    return best_per_query(scored, id_col, k).select("query_id", id_col, *table.carry, "score", "rank")

