"""Exact top-k over stored blocks of rows that are skipped when a bound says that they can't matter.

Whatever the scores are: from a block's head follows, for each query, the most that a row of it can score. The most
promising blocks of each query are scored first; the k-th best score they give is a floor, and only the (query, block)
pairs that may reach it are scored in the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlore.session import materialise

#: Bounds are compared with a margin, so that rounding never skips a block.
MARGIN = 1e-8
#: Bounds that a task has at a time, and rows that it hands out together.
BOUND_CELLS, PROMISING_AT_ONCE = 1 << 20, 1 << 16

#: Made in a task; from a batch of heads to [query, block], minus infinity where the query needs none of it.
Bounds = Callable[[pa.RecordBatch], np.ndarray]
#: Best k rows of each query over (key columns, asked: numbers of queries, see ``numbers``), given each query's floor.
Score = Callable[[DataFrame, Broadcast], DataFrame]


def bounded_topk(head: DataFrame, keys: list[str], bounds: Callable[[], Bounds], score: Score, queries: Broadcast, k: int, seeds: int) -> tuple[DataFrame, DataFrame]:
    """(best k rows of each query, the (block, queries) pairs that were scored in the end).

    The pairs are written as a bit a query, since where bounds leave out little they are all queries of all blocks.
    ``head``: a small row per block, read twice. ``queries``: an Arrow table that was checked to be small, so a floor per
    query is small as well; it is all that comes to the driver.
    """
    sc = head.sparkSession.sparkContext
    kinds = {f.name: f.dataType.simpleString() for f in head.schema.fields}
    columns = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    n = queries.value.num_rows

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        bound, rows = bounds(), max(1, BOUND_CELLS // max(1, n))
        for batch in batches:
            for start in range(0, batch.num_rows if n else 0, rows):
                some = batch.slice(start, rows)
                yield some, bound(some)

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best blocks of each query among those of the task."""
        best, place, seen, total = np.full((n, seeds), -np.inf), np.zeros((n, seeds), np.int64), [], 0
        for batch, limit in limits(batches):
            few = min(seeds, batch.num_rows)
            at = np.argpartition(-limit, few - 1, axis=1)[:, :few]
            bound, where = np.concatenate([best, np.take_along_axis(limit, at, 1)], 1), np.concatenate([place, at + total], 1)
            at = np.argpartition(-bound, seeds - 1, axis=1)[:, :seeds]
            best, place = np.take_along_axis(bound, at, 1), np.take_along_axis(where, at, 1)
            seen.append(batch.select(keys))
            total += batch.num_rows
        q, s = np.nonzero(best > -np.inf)
        for start in range(0, len(q), PROMISING_AT_ONCE):
            some = slice(start, start + PROMISING_AT_ONCE)
            blocks = pa.Table.from_batches(seen).take(pa.array(place[q[some], s[some]])).combine_chunks()
            columns = [pa.array(q[some], pa.int64()), *blocks.columns, pa.array(best[q[some], s[some]])]
            yield from pa.Table.from_arrays(columns, names=["query", *keys, "bound"]).to_batches()

    first = head.mapInArrow(promising, f"query bigint, {columns}, bound double")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), *keys)
    best = first.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= seeds)
    asked = materialise(best.groupBy(*keys).agg(F.collect_list("query").alias("asked")))
    tried = score(asked, sc.broadcast(np.full(n, -np.inf)))
    kth = tried.where(F.col("rank") == k).select("query_id", "score").toPandas()
    place = {q: i for i, q in enumerate(queries.value["query_id"].to_pylist())}
    floor = np.full(n, -np.inf)
    floor[[place[q] for q in kth["query_id"]]] = kth["score"]
    floor = sc.broadcast(floor)

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, limit in limits(batches):
            needed = (limit > -np.inf) & (limit >= floor.value[:, None] - MARGIN)
            at = np.flatnonzero(needed.any(0))
            bits = pa.array([x.tobytes() for x in np.packbits(needed[:, at], axis=0).T], pa.binary())
            yield pa.RecordBatch.from_arrays([*taken(batch, keys, at), bits], names=[*keys, "asked"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked = numbers(batch.column("asked"), i)
                lists = pa.ListArray.from_arrays(pa.array([0, len(asked)], pa.int32()), pa.array(asked, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken(batch, keys, np.array([i])), lists], names=[*keys, "asked"])

    pairs = materialise(head.mapInArrow(reaching, f"{columns}, asked binary"))
    return score(pairs, floor), pairs.mapInArrow(listed, f"{columns}, asked array<bigint>")


def numbers(asked: pa.Array, i: int) -> np.ndarray:
    """The numbers of queries that a row is asked for, from a list of them or from a bit for each."""
    if pa.types.is_list(asked.type):
        return np.array(asked[i].values)
    return np.flatnonzero(np.unpackbits(np.frombuffer(asked[i].as_buffer(), np.uint8)))


def taken(batch: pa.RecordBatch, columns: list[str], at: np.ndarray) -> list[pa.Array]:
    return [batch.column(c).take(pa.array(at, pa.int64())) for c in columns]
