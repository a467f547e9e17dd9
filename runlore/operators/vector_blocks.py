"""Stored vectors for exact search with metric pruning.

Vectors lie in folders of their nearest centroid, cut into blocks. A block's head has the mean of its vectors and the
distance of the furthest from it. By the triangle inequality no vector of the block is nearer to a query than the mean
less that radius, so from the heads alone follows which blocks can't hold a result; their folders are not read. The
results are those of the exact search over all vectors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from runlore.operators.blocks import bounded_topk, numbers
from runlore.operators.centroids import columns_of, k_means, nearest, sample, unit
from runlore.operators.search import METRICS, filter_columns
from runlore.operators.topk import (
    BROADCAST_BYTES, HELD_ROWS, QUERIES_AT_ONCE, ROUNDED_K, DenseScorer, _Block, _emit, _pieces, best_per_query, list_matrix, square_sums,
    table_bytes,
)
from runlore.session import materialise

#: Vectors in a block, and the most cells that a table gets unless told otherwise.
BLOCK_ROWS = 256
MOST_CELLS = 1024
#: Rows of blocks that a search scores together.
ROWS_TOGETHER = 1 << 12
#: Rows of one cell that a task keeps in a row before another task may take more of them.
CELL_SHARE = 1 << 18
SEEDS = 4
BLOCK_BITS = 33


@dataclass(frozen=True)
class VectorBlocks:
    """An opened table of blocks, for one metric."""

    spark: SparkSession
    root: str
    metric: str
    payload: tuple[str, ...]
    kinds: tuple[T.DataType, ...]

    def heads(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/heads")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")


def spread_cells(vectors: DataFrame, centres: np.ndarray, payload: list[str]) -> DataFrame:
    """(cell, payload, embedding), the rows of a cell together; a cell with very many rows is dealt to several tasks."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    kinds = {f.name: f.dataType for f in vectors.schema.fields}
    schema = T.StructType([T.StructField("cell", T.IntegerType()), *[T.StructField(c, kinds[c]) for c in (*payload, "embedding")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = nearest(unit(list_matrix(batch.column("embedding"))), shared.value)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], names=schema.names)

    placed = materialise(vectors.where(F.col("embedding").isNotNull()).select(*payload, "embedding").mapInArrow(run, schema))
    shares = placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_SHARE).cast("int").alias("_shares"))  # a row per cell
    dealt = placed.join(F.broadcast(shares), "cell").withColumn("_share", F.pmod(F.xxhash64(payload[0]), F.col("_shares")))
    return dealt.repartition("cell", "_share").sortWithinPartitions("cell", payload[0]).select("cell", *payload, "embedding")


def write_blocks(vectors: DataFrame, path: str, metric: str = "cosine", id_col: str = "chunk_id", carry: tuple[str, ...] = (),
                 cells: int | None = None, block_rows: int = BLOCK_ROWS) -> VectorBlocks:
    """Write the vectors in blocks; rows without a vector are left out. Centroids come from a bounded sample."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    spark, path, payload = vectors.sparkSession, path.rstrip("/"), list(dict.fromkeys([id_col, *carry]))
    kinds = [vectors.schema[c].dataType for c in payload]
    points = sample(vectors, id_col)
    if not len(points):
        return VectorBlocks(spark, "", metric, tuple(payload), tuple(kinds))
    cells = cells or max(1, min(MOST_CELLS, len(points) // block_rows))
    element = vectors.schema["embedding"].dataType.elementType
    schema = T.StructType([
        T.StructField("cell", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType()),
        T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("radius", T.DoubleType()), T.StructField("one", T.BooleanType()),
        *[T.StructField(f"p_{c}", T.ArrayType(t)) for c, t in zip(payload, kinds, strict=True)], T.StructField("flat", T.ArrayType(element))])
    arrow = to_arrow_schema(schema)
    types = [to_arrow_type(t) for t in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << BLOCK_BITS, None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            cell = held["cell"].to_numpy()
            ends = [*np.flatnonzero(cell[1:] != cell[:-1]) + 1]  # the last cell may go on in the next batch
            first = 0
            for end in [*ends, len(cell)]:
                while end - first >= block_rows or (end < len(cell) and end > first):
                    n = min(block_rows, end - first)
                    yield block(held.slice(first, n), number)
                    first, number = first + n, number + 1
            held = held.slice(first)
        if held is not None and held.num_rows:
            yield block(held, number)

    def block(rows: pa.Table, number: int) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        m = list_matrix(rows["embedding"])
        if metric == "cosine":
            m = unit(m)
        centre = m.mean(0)
        radius = float(np.sqrt(((m - centre) ** 2).sum(1)).max())
        one = metric == "cosine" and bool((m * m).sum(1).all())
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        values = [rows["cell"][0].as_py(), number, rows.num_rows, centre.tolist(), radius, one]
        lists = [whole(rows[c].combine_chunks().cast(t)) for c, t in zip(payload, types, strict=True)]
        vectors = whole(rows["embedding"].combine_chunks().flatten())
        return pa.RecordBatch.from_arrays([*[pa.array([v], f.type) for v, f in zip(values, list(arrow)[:6], strict=True)], *lists, vectors], schema=arrow)

    built = materialise(spread_cells(vectors, k_means(points, cells), payload).mapInArrow(run, schema))
    built.select("cell", "block", *[F.col(f"p_{c}").alias(c) for c in payload], "flat").write.partitionBy("cell").parquet(f"{path}/rows")
    built.select("cell", "block", "n", "centre", "radius", "one").write.parquet(f"{path}/heads")
    spark.createDataFrame([(json.dumps({"metric": metric, "payload": payload}),)], "about string").coalesce(1).write.text(f"{path}/about")
    return VectorBlocks(spark, path, metric, tuple(payload), tuple(kinds))


def open_blocks(spark: SparkSession, path: str) -> VectorBlocks:
    about = json.loads(spark.read.text(f"{path.rstrip('/')}/about").first()[0])
    schema = spark.read.parquet(f"{path.rstrip('/')}/rows").schema
    return VectorBlocks(spark, path.rstrip("/"), about["metric"], tuple(about["payload"]), tuple(schema[c].dataType.elementType for c in about["payload"]))


def block_bounds(queries: np.ndarray, metric: str, centre: np.ndarray, radius: np.ndarray, one: np.ndarray,
                 squares: np.ndarray | None = None) -> np.ndarray:
    """[query, block]: the most that a vector of the block can score. For cosine, queries are unit vectors, as are a
    block's vectors where ``one`` says so (else some are zero). ``squares``: ``square_sums`` of the queries if they are
    there already."""
    product = queries @ centre.T
    q2, c2 = square_sums(queries) if squares is None else squares, (centre * centre).sum(1)
    near = np.sqrt(np.maximum(0.0, q2[:, None] - 2 * product + c2[None, :])) - radius[None, :]
    near = np.maximum(0.0, near - 1e-9)
    if metric == "l2":
        return -(near * near)
    reach = product + np.sqrt(q2)[:, None] * radius[None, :]
    if metric == "cosine":
        reach = np.minimum(reach, np.where(one[None, :] & (q2 > 0)[:, None], 1 - near * near / 2, np.inf))
    return reach


def search_blocks(table: VectorBlocks, queries: DataFrame, k: int = 10, missing_passes: bool = False, seeds: int = SEEDS,
                  broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """((query_id, *payload, score, rank) of the k nearest rows per query, (cell, block, asked): the blocks that were
    scored, and for which of the queries, by number).

    ``queries``: query_id, embedding and filter columns ``f_<key>`` of carried columns; as ``search.search`` in mode
    "pre". Queries of more than ``broadcast_bytes``, or with more results than a task may hold, go in rounds of one at least. No stored vectors give no rows.
    """
    payload = list(table.payload)
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("score", T.DoubleType()),
                           *[T.StructField(c, t) for c, t in zip(payload, table.kinds, strict=True)]])
    if not table.root:
        none = queries.sparkSession.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
        return none.select("query_id", *payload, "score", "rank"), None
    keys = filter_columns(queries, table.rows())
    wanted = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding", *[f"f_{c}" for c in keys])
    n, size = table_bytes(wanted)
    rounds = max(1, min(n, max(-(-size // max(1, broadcast_bytes)), -(-n * k // HELD_ROWS) if k <= ROUNDED_K else 0)))
    if rounds == 1:
        found, scored = _round(table, wanted, schema, keys, k, missing_passes, seeds)
    else:
        wanted, parts = materialise(wanted), []
        for i in range(rounds):
            found, scored = _round(table, wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == i), schema, keys, k, missing_passes, seeds)
            parts.append((materialise(found), scored))
        found, scored = (reduce(DataFrame.unionByName, p) for p in zip(*parts, strict=True))
    return found.select("query_id", *payload, "score", "rank"), scored


def _round(table: VectorBlocks, wanted: DataFrame, schema: T.StructType, keys: tuple[str, ...], k: int, missing_passes: bool, seeds: int) -> tuple[DataFrame, DataFrame]:
    payload, shared = list(table.payload), table.spark.sparkContext.broadcast(wanted.toArrow())
    metric, arrow, types = table.metric, to_arrow_schema(schema), [to_arrow_type(t) for t in table.kinds]

    def bounds():
        vectors = DenseScorer(shared.value, metric).vectors
        squares = square_sums(vectors)

        def of(batch: pa.RecordBatch) -> np.ndarray:
            return block_bounds(vectors, metric, list_matrix(batch.column("centre")), batch.column("radius").to_numpy(),
                                batch.column("one").to_numpy(zero_copy_only=False), squares)

        return of

    def score(asked: DataFrame, floor: Broadcast) -> DataFrame:
        cells = [r.cell for r in asked.select("cell").distinct().collect()]  # folders to read
        n = len(floor.value)
        few = asked.count() * (n // 8 + 16) + 8 * n * seeds <= BROADCAST_BYTES  # a bit or a number each
        wanted = asked.select("block", "asked")
        met = table.rows().where(F.col("cell").isin(cells)).join(F.broadcast(wanted) if few else wanted, "block").select("asked", "flat", *payload)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            block = _Block(known, partial(DenseScorer, metric=metric), keys, missing_passes, k)
            for rows, need in _together(batches, known.num_rows, payload, types):
                if not block.parts:
                    block.open(rows)
                    for part in block.parts:
                        for i, best in enumerate(part.best):
                            best.kth = floor.value[part.numbers[i * QUERIES_AT_ONCE :][: len(best.kth)]]
                codes = block.allowed.codes(rows) if block.apart else []
                for part in block.parts:
                    own = rows.filter(pa.array(block.allowed.mask(part.numbers[0], part.numbers[0] + 1, codes)[0])) if block.apart else rows
                    asked_of = np.flatnonzero(need[part.numbers])
                    others = sum(other.held() for other in block.parts if other is not part)
                    for piece in _pieces(own) if len(asked_of) else ():
                        mask = None if block.apart else block.mask(piece)
                        for found in part.add(piece, part.scorer.prepare(piece), payload, -np.inf, mask, HELD_ROWS - others, asked_of):
                            yield from _emit(found, known["query_id"], arrow).to_batches(max_chunksize=10_000)
            for part in block.parts:
                for i in range(len(part.best)):
                    for found in part.taken(i):
                        yield from _emit(found, known["query_id"], arrow).to_batches(max_chunksize=10_000)

        return best_per_query(met.mapInArrow(run, schema), payload[0], k)

    return bounded_topk(table.heads(), ["cell", "block"], bounds, score, shared, k, seeds)


def _together(batches: Iterator[pa.RecordBatch], n: int, payload: list[str], types: list[pa.DataType]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows of some blocks, whether a query needs any of them): blocks go together as long as at least half of the
    pairs of a query and a row are asked for."""
    held, n_rows, pairs, union = [], 0, 0, np.zeros(n, dtype=bool)
    for batch in batches:
        for i in range(batch.num_rows):
            flat, lists = batch.column("flat")[i].values, [batch.column(c)[i].values.cast(t) for c, t in zip(payload, types, strict=True)]
            size, need = len(lists[0]), np.zeros(n, dtype=bool)
            need[numbers(batch.column("asked"), i)] = True
            both, more = union | need, int(need.sum()) * size
            if held and (n_rows + size > ROWS_TOGETHER or int(both.sum()) * (n_rows + size) > 2 * (pairs + more)):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], union
                held, n_rows, pairs, both = [], 0, 0, need
            offsets = pa.array(np.arange(0, len(flat) + 1, max(1, len(flat) // size)), pa.int32())
            held.append(pa.RecordBatch.from_arrays([*lists, pa.ListArray.from_arrays(offsets, flat)], names=[*payload, "embedding"]))
            n_rows, pairs, union = n_rows + size, pairs + more, both
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], union
