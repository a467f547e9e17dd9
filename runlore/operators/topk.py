"""Top-k of every query against a corpus, without forming the pairs as rows.

A scorer turns a block of queries and an Arrow batch of corpus rows into a score matrix inside a task; only the best
k rows per query leave the task, and one window per query merges them. Ways to bring queries and corpus together:

* ``broadcast_topk``: the queries, checked to be under a byte bound, go to every task. The corpus is not shuffled.
* ``rounds_topk``: larger query sets, or those with more results than a task may hold, go in blocks under those bounds.
  A task scores one block after the other; as many as it may hold are one job, which reads the corpus once where it lies.
* ``index_topk``: a corpus under that bound goes to every task instead if a query may have many results. A task ranks all
  results of its queries, so none of them are shuffled.
* ``grid_topk``: both sides are cut into bounded blocks per cell and each pair of blocks meets in one task: the
  approximate search within cells. A hot cell simply has more blocks.

Scores are plain functions of (query, row): the matrix product only preselects, with a margin above its rounding
error, and the survivors are scored again in a fixed order. So equal rows tie exactly and ties break by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from runlore.session import materialise

BROADCAST_BYTES = 64 << 20
BLOCK_BYTES = 32 << 20
MATRIX_CELLS = 1 << 23
#: Scores that a scan has at a time.
SCAN_CELLS = 1 << 22
#: Queries of a task whose best rows are merged together, pairs that are scored exactly at a time and that wait for a
#: merge, and rows that a task holds before it hands some out.
QUERIES_AT_ONCE, PAIRS_AT_ONCE, PAIRS_HELD, HELD_ROWS = 4096, 1 << 10, 1 << 19, 1 << 21
#: Scores of which only the largest counts where a bound is looked for.
FOLDED = 16
#: Groups of equal filters that are searched apart, and how often their rows may overlap on average.
FILTER_GROUPS, OVERLAP = 256, 4
#: Shares of a group of equal filters that may go in different jobs.
SHARES = 1000
#: Bytes of rows that are prepared at a time.
PREPARED_BYTES = 8 << 20
#: Up to this k, rounds are so small that a task holds k rows of each of their queries.
ROUNDED_K = 1024
#: Beyond it: rows that a task scores exactly at a time, ranked rows that it hands out together, and pairs of a task.
ROWS_AT_ONCE, RANKED_AT_ONCE, PAIRS_OF_TASK = 1 << 11, 1 << 17, 1 << 24
EPS32 = float(np.finfo(np.float32).eps)


class Scorer(Protocol):
    """Built from an Arrow table of queries; scores batches of corpus rows."""

    n: int
    #: Whether rows are prepared alike for all queries, so that blocks of queries can share them.
    rows_alike: bool

    def prepare(self, batch: pa.RecordBatch) -> object: ...

    def estimate(self, lo: int, hi: int, rows: object) -> tuple[np.ndarray, float]:
        """Scores of queries lo..hi against the rows, and how far they may be from the exact ones."""

    def exact(self, queries: np.ndarray, rows: np.ndarray | slice, prepared: object, estimates: np.ndarray) -> np.ndarray:
        """Scores of pairs; a single query with several rows stands for its pairs with all of them."""


ScorerFactory = Callable[[pa.Table], Scorer]


def list_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix of its own; rows of different lengths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    width = len(column[0])
    lengths = pc.list_value_length(column)
    if column.null_count or pc.min_max(lengths).as_py() != {"min": width, "max": width}:
        raise ValueError("vectors must be present and of one length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def square_sums(m: np.ndarray, rows: int = 1 << 13) -> np.ndarray:
    """Of the rows of a matrix, without the squares of all of them at once."""
    return np.concatenate([np.zeros(0), *[(m[i : i + rows] * m[i : i + rows]).sum(axis=1) for i in range(0, len(m), rows)]])


class DenseScorer:
    """Cosine, inner product or negative squared distance of dense vectors."""

    rows_alike = True

    def __init__(self, queries: pa.Table, metric: str = "cosine"):
        self.metric = metric
        self.vectors = self._ready(list_matrix(queries["embedding"]))
        self.single = self.vectors.astype(np.float32)
        self.n = len(self.vectors)
        self.reach = self._reach(self.vectors)

    def _ready(self, m: np.ndarray) -> np.ndarray:
        if self.metric != "cosine" or not m.size:
            return m
        length = np.sqrt(square_sums(m))[:, None]
        m /= np.where(length > 0, length, 1.0)  # a matrix of its own, see list_matrix
        return m

    @staticmethod
    def _reach(m: np.ndarray) -> float:
        return float(np.sqrt(square_sums(m)).max()) if m.size else 0.0

    def prepare(self, batch):
        rows = self._ready(list_matrix(batch["embedding"]))
        if rows.size and rows.shape[1] != self.vectors.shape[1]:
            raise ValueError(f"queries have {self.vectors.shape[1]} dimensions, rows {rows.shape[1]}")
        return rows, rows.astype(np.float32), self._reach(rows)

    def estimate(self, lo, hi, prepared):
        return self.estimate_some(slice(lo, hi), prepared)

    def estimate_some(self, queries: np.ndarray | slice, prepared):
        rows, single, reach = prepared
        q = self.single[queries]
        scores = q @ single.T
        bound = self.reach * reach
        if self.metric == "l2":
            scores = 2 * scores - (q * q).sum(axis=1)[:, None] - (single * single).sum(axis=1)[None, :]
            bound = (self.reach + reach) ** 2
        return scores, 4 * EPS32 * (rows.shape[1] + 2) * bound

    def exact(self, queries, rows, prepared, estimates):
        a, b = self.vectors[queries], prepared[0][rows]
        if self.metric == "l2":
            return -((a - b) ** 2).sum(axis=1)
        return (a * b).sum(axis=1)


class AllowedValues:
    """Per query the metadata values it accepts: none given accepts all, a missing value only matches a null.

    Values are compared by code. A table of queries and values exists only for list filters, and only for the queries
    that are scored at a time."""

    ALL = -1

    def __init__(self, queries: pa.Table, keys: tuple[str, ...], missing_passes: bool):
        self.missing_passes, self.n = missing_passes, queries.num_rows
        self.keys = []
        for key in keys:
            wanted = queries[f"f_{key}"].to_pylist()
            is_list = _scalar_type(queries[f"f_{key}"].type) != queries[f"f_{key}"].type
            lists = [None if w is None else (w if is_list else [w]) for w in wanted]
            values = sorted({v for w in lists if w for v in w if v is not None}, key=str)
            code = {v: i for i, v in enumerate(values)} | {None: len(values)}
            coded = [[self.ALL] if w is None else [code[v] for v in w] for w in lists]
            accepted = coded if is_list else np.array([c[0] for c in coded], dtype=np.int64)
            self.keys.append((key, pa.array(values, type=_scalar_type(queries[f"f_{key}"].type)), len(values), accepted))

    def codes(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        out = []
        for key, values, missing, _ in self.keys:
            column = batch[key]
            found = pc.index_in(column, value_set=values.cast(column.type), skip_nulls=True)
            found = pc.if_else(pc.is_null(column), missing, pc.fill_null(found, missing + 1))
            out.append(found.to_numpy(zero_copy_only=False))
        return out

    def mask(self, lo: int, hi: int, codes: list[np.ndarray]) -> np.ndarray | None:
        return self.mask_of(np.arange(lo, hi), codes)

    def mask_of(self, queries: np.ndarray, codes: list[np.ndarray]) -> np.ndarray | None:
        """[query, row]: whether the row satisfies all filters of the query, for these queries only."""
        mask = None
        for (_, _, missing, accepted), code in zip(self.keys, codes):
            if isinstance(accepted, list):
                allowed = np.zeros((len(queries), missing + 2), dtype=bool)
                for row, i in zip(allowed, queries.tolist()):
                    row[slice(None) if accepted[i] == [self.ALL] else accepted[i]] = True
                this = allowed[:, code]
            else:
                wanted = accepted[queries, None]
                this = (wanted == code[None, :]) | (wanted == self.ALL)
            if self.missing_passes:
                this |= (code == missing)[None, :]
            mask = this if mask is None else mask & this
        return mask

    def groups(self) -> list[np.ndarray]:
        """The numbers of queries that accept the same values, a group each."""
        which = np.zeros(self.n, dtype=np.int64)
        for _, _, _, accepted in self.keys:
            if isinstance(accepted, list):
                seen: dict[tuple, int] = {}
                own = np.array([seen.setdefault(tuple(sorted(w)), len(seen)) for w in accepted], dtype=np.int64)
            else:
                own = np.unique(accepted, return_inverse=True)[1]
            which = np.unique(which * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
        order = np.argsort(which, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(which[order])) + 1)


def _scalar_type(t: pa.DataType) -> pa.DataType:
    return t.value_type if pa.types.is_list(t) or pa.types.is_large_list(t) else t


class Best:
    """The best k rows per query seen so far, with the payload of those rows."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.kth = np.full(n, -np.inf)
        self.query = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0)
        self.rows: pa.Table | None = None

    def merge(self, query: np.ndarray, score: np.ndarray, rows: pa.Table) -> None:
        untouched = None
        if self.rows is not None:
            touched = np.zeros(len(self.kth), dtype=bool)
            touched[query] = True
            old = touched[self.query]
            untouched = self.query[~old], self.score[~old], self.rows.filter(pa.array(~old))
            query, score = np.concatenate([self.query[old], query]), np.concatenate([self.score[old], score])
            rows = pa.concat_tables([self.rows.filter(pa.array(old)), rows])
        order = pc.sort_indices(
            pa.table({"q": query, "s": score, "id": rows.column(0)}),
            sort_keys=[("q", "ascending"), ("s", "descending"), ("id", "ascending")],
        ).to_numpy()
        query, score = query[order], score[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        keep, full = place < self.k, place == self.k - 1
        self.kth[query[full]] = score[full]
        query, score, rows = query[keep], score[keep], rows.take(pa.array(order[keep]))
        if untouched is not None:
            query, score = np.concatenate([untouched[0], query]), np.concatenate([untouched[1], score])
            rows = pa.concat_tables([untouched[2], rows])
        self.query, self.score, self.rows = query, score, rows.combine_chunks()


class _Part:
    """Queries whose filters are equal, or all of them: their scorer and their best rows, by blocks of queries."""

    def __init__(self, numbers: np.ndarray, scorer: Scorer, k: int):
        self.numbers, self.scorer, self.k = numbers, scorer, k
        self.best = [Best(min(QUERIES_AT_ONCE, len(numbers) - lo), k) for lo in range(0, len(numbers), QUERIES_AT_ONCE)]

    def held(self) -> int:
        return sum(len(best.query) for best in self.best)

    def taken(self, i: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
        """The rows of a block of queries, which then holds none. What it knows of their scores stays."""
        best = self.best[i]
        if best.rows is not None:
            yield self.numbers[best.query + i * QUERIES_AT_ONCE], best.score, best.rows
            best.query, best.score, best.rows = best.query[:0], best.score[:0], None

    def add(self, batch: pa.RecordBatch, prepared, payload: list[str], floor: float, mask: Callable | None, room: int,
            need: np.ndarray | None = None) -> Iterator:
        """Score the prepared rows, for all queries or those with the numbers ``need``, in order; blocks that hold more than
        ``room`` rows in all are handed out."""
        n_rows, columns = batch.num_rows, pa.Table.from_batches([batch]).select(payload)
        slab = max(1, (SCAN_CELLS if self.k < n_rows else SCAN_CELLS >> 2) // n_rows)
        for i, best in enumerate(self.best):
            first, found, pairs = i * QUERIES_AT_ONCE, [], 0
            wanted = np.arange(len(best.kth))
            if need is not None:
                wanted = need[slice(*np.searchsorted(need, [first, first + len(best.kth)]))] - first
            for lo in range(0, len(wanted), slab):
                q, r, score = self._slab(first, wanted[lo : lo + slab], best, prepared, n_rows, floor, mask)
                found.append((q, r, score))
                pairs += len(q)
                if pairs >= PAIRS_HELD or lo + slab >= len(wanted):
                    q, r, score = (np.concatenate(x) for x in zip(*found, strict=True))
                    found, pairs = [], 0
                    if len(q):
                        best.merge(q, score, columns.take(pa.array(r)))
                    if self.held() > room:
                        yield from self.taken(i)

    def _slab(self, first: int, some: np.ndarray, best: Best, prepared, n_rows: int, floor: float, mask: Callable | None):
        lo, hi = first + int(some[0]), first + int(some[-1]) + 1
        scores, error = self.scorer.estimate(lo, hi, prepared) if hi - lo == len(some) else self.scorer.estimate_some(some + first, prepared)
        if mask is not None:
            scores = np.where(mask(some + first), scores, -np.inf)
        cut, lowest = best.kth[some], np.nextafter(floor - error, np.inf)
        if open_ := n_rows > self.k and np.isinf(cut).any():
            cut = np.maximum(cut, kth_bound(scores, self.k))
        q, r = reaching(scores, np.maximum(cut - 2 * error, lowest))
        if n_rows > self.k and not open_ and len(q) > 4 * self.k * len(some):  # what is known is far from these rows' best
            q, r = reaching(scores, np.maximum(np.maximum(cut, kth_bound(scores, self.k)) - 2 * error, lowest))
        estimates = scores[q, r]
        del scores
        q, exact = some[q], np.empty(len(q))
        for at in range(0, len(q), PAIRS_AT_ONCE):
            part = slice(at, at + PAIRS_AT_ONCE)
            exact[part] = self.scorer.exact(q[part] + first, r[part], prepared, estimates[part])
        keep = (exact >= best.kth[q]) & (exact > floor)
        return q[keep], r[keep], exact[keep]


def kth_bound(scores: np.ndarray, k: int) -> np.ndarray:
    """Of each row a bound that at least k of its scores reach, close to the k-th largest. Groups of scores are folded to
    their largest first, as long as far more than k are left."""
    n = scores.shape[1]
    groups = n // FOLDED
    if groups > FOLDED * k:
        scores = scores[:, : groups * FOLDED].reshape(len(scores), FOLDED, groups).max(axis=1)
        n = groups
    return np.partition(scores, n - k, axis=1)[:, n - k]


def reaching(scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells (row, column) of finite scores that reach the least one of their row."""
    lowest = np.finfo(scores.dtype).min
    least = np.maximum(least, lowest)
    if scores.dtype == np.float32:  # compared as they are, with the bound rounded down
        with np.errstate(over="ignore"):
            least = np.maximum(np.nextafter(least.astype(np.float32), np.float32(-np.inf)), lowest)
    return np.divmod(np.flatnonzero(scores >= least[:, None]), scores.shape[1])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch, halved until no piece of more than a row is over ``PREPARED_BYTES``."""
    if batch.num_rows > 1 and batch.nbytes > PREPARED_BYTES:
        half = batch.num_rows // 2
        yield from _pieces(batch.slice(0, half))
        yield from _pieces(batch.slice(half))
    elif batch.num_rows:
        yield batch


def _scan(
    batches, queries: pa.Table, scorer: ScorerFactory, filter_keys: tuple[str, ...], missing_passes: bool, k: int,
    payload: list[str], floor: float,
) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """(numbers of queries, scores, rows): all that may be among the k best of the batches, and at most k rows of a
    query as long as ``HELD_ROWS`` hold k rows of each; memory is bounded whatever k is."""
    for _, found in _scan_blocks(batches, [queries], scorer, filter_keys, missing_passes, k, payload, floor):
        yield found


class _Block:
    """A block of queries in a task, in parts by their filters as soon as rows show whether that pays.

    Queries with equal filters go together and meet only the rows that satisfy them, unless there are many such groups
    or their rows overlap; then all are scored and the scores masked."""

    def __init__(self, queries: pa.Table, scorer: ScorerFactory, filter_keys: tuple[str, ...], missing_passes: bool, k: int):
        self.queries, self.scorer, self.k, self.filtered = queries, scorer, k, bool(filter_keys)
        self.allowed = AllowedValues(queries, filter_keys, missing_passes)
        self.parts: list[_Part] = []
        self.apart = False

    def open(self, batch: pa.RecordBatch) -> None:
        groups, codes = self.allowed.groups() if self.filtered else [], self.allowed.codes(batch)
        if 0 < len(groups) <= FILTER_GROUPS:
            self.apart = sum(self.allowed.mask(g[0], g[0] + 1, codes).sum() for g in groups) <= OVERLAP * batch.num_rows
        self.parts = [_Part(g, self.scorer(self.queries.take(pa.array(g))), self.k) for g in groups] if self.apart else [
            _Part(np.arange(self.queries.num_rows), self.scorer(self.queries), self.k)]

    def mask(self, piece: pa.RecordBatch) -> Callable | None:
        codes = self.allowed.codes(piece)
        return (lambda queries: self.allowed.mask_of(queries, codes)) if self.filtered else None


def _scan_blocks(
    batches, blocks: list[pa.Table], scorer: ScorerFactory, filter_keys: tuple[str, ...], missing_passes: bool, k: int,
    payload: list[str], floor: float,
) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, pa.Table]]]:
    """As ``_scan``, with the number of the block that the queries are of. ``HELD_ROWS`` holds for all blocks together."""
    opened = {i: _Block(q, scorer, filter_keys, missing_passes, k) for i, q in enumerate(blocks) if q.num_rows}
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        together = []  # parts that meet all rows
        for number, block in opened.items():
            if not block.parts:
                block.open(batch)
            if not block.apart:
                together.append((number, block, block.parts[0]))
                continue
            codes = block.allowed.codes(batch)
            for part in block.parts:
                own = batch.filter(pa.array(block.allowed.mask(part.numbers[0], part.numbers[0] + 1, codes)[0]))
                for piece in _pieces(own):
                    held -= part.held()
                    for found in part.add(piece, part.scorer.prepare(piece), payload, floor, None, HELD_ROWS - held):
                        yield number, found
                    held += part.held()
        for piece in _pieces(batch) if together else ():
            prepared = None
            for number, block, part in together:
                if prepared is None or not part.scorer.rows_alike:
                    prepared = part.scorer.prepare(piece)
                held -= part.held()
                for found in part.add(piece, prepared, payload, floor, block.mask(piece), HELD_ROWS - held):
                    yield number, found
                held += part.held()
    for number, block in opened.items():
        for part in block.parts:
            for i in range(len(part.best)):
                for found in part.taken(i):
                    yield number, found


def _emit(found: tuple[np.ndarray, np.ndarray, pa.Table], query_ids: pa.ChunkedArray, schema: pa.Schema) -> pa.Table:
    query, score, rows = found
    columns = [query_ids.take(pa.array(query)), pa.array(score), *rows.columns]
    return pa.Table.from_arrays(columns, names=schema.names).cast(schema)


def _output_schema(corpus: DataFrame, queries: DataFrame, payload: list[str]) -> T.StructType:
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("score", T.DoubleType())]
    return T.StructType(fields + [T.StructField(c, corpus.schema[c].dataType) for c in payload])


def best_per_query(candidates: DataFrame, id_col: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _row_bytes(df: DataFrame):
    """Rough bytes of a row as a column: eight per array element, the length of strings, eight for the rest."""
    total = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            size = F.size(c) * (24 if isinstance(f.dataType.elementType, T.StringType) else 8)
        else:
            size = F.length(c) if isinstance(f.dataType, T.StringType) else F.lit(8)
        total = total + F.greatest(F.coalesce(size, F.lit(0)), F.lit(0))
    return total


def table_bytes(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def topk(
    corpus: DataFrame,
    queries: DataFrame,
    scorer: ScorerFactory,
    k: int,
    payload: list[str],
    filter_keys: tuple[str, ...] = (),
    missing_passes: bool = False,
    floor: float = -np.inf,
    broadcast_bytes: int = BROADCAST_BYTES,
    costly: bool = False,
) -> DataFrame:
    """(query_id, score, *payload, rank): for each query the k best corpus rows. ``payload[0]`` is the row id.

    Queries of more than ``broadcast_bytes``, or whose k best rows are more than ``HELD_ROWS``, go in blocks, of one
    query at the least. With a k beyond ``ROUNDED_K`` a corpus of at most ``broadcast_bytes`` goes to the queries. A
    corpus that is ``costly`` to compute is written once for them."""
    n, size = table_bytes(queries)
    if n and k > ROUNDED_K:
        corpus, costly = materialise(corpus) if costly else corpus, False
        n_rows, corpus_size = table_bytes(corpus)
        if corpus_size <= broadcast_bytes:
            tasks = -(-n * n_rows // PAIRS_OF_TASK)
            return index_topk(max(1, min(n, tasks)), corpus, queries, scorer, k, payload, filter_keys, missing_passes, floor)
    rounds = min(n, max(-(-size // max(1, broadcast_bytes)), -(-n * k // HELD_ROWS) if k <= ROUNDED_K else 0))
    if rounds <= 1:
        return broadcast_topk(corpus, queries, scorer, k, payload, filter_keys, missing_passes, floor)
    # In the order of its filter columns, so that a job skips what its queries don't accept.
    corpus = materialise(corpus.sortWithinPartitions(*filter_keys) if filter_keys else corpus) if costly else corpus
    return rounds_topk(rounds, corpus, queries, scorer, k, payload, filter_keys, missing_passes, floor)


def rounds_topk(
    blocks: int, corpus: DataFrame, queries: DataFrame, scorer: ScorerFactory, k: int, payload: list[str],
    filter_keys: tuple[str, ...] = (), missing_passes: bool = False, floor: float = -np.inf,
) -> DataFrame:
    """The queries in so many blocks by a hash of their id. Blocks of up to ``BROADCAST_BYTES`` and ``HELD_ROWS`` in all go in
    one job, and its results are written before the next begins. Where filters are, queries of equal ones go in the same
    job as far as it holds them, and the job reads the rows that they accept."""
    rows = materialise(queries)
    n, size = table_bytes(rows)
    jobs = min(blocks, max(1, -(-size // BROADCAST_BYTES), -(-n * k // HELD_ROWS) if k <= ROUNDED_K else 0))
    each = -(-blocks // jobs)
    numbered = rows.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(each)).cast("int"))
    share = F.pmod(F.xxhash64("query_id", F.lit(jobs)), F.lit(SHARES))
    wanted = jobs_by_filter(rows, corpus, filter_keys, jobs, share, missing_passes) if jobs > 1 else None
    if wanted is None:
        wanted = [(F.floor(share * jobs / SHARES) == j, F.lit(True)) for j in range(jobs)]
    parts, whole = [], corpus
    for asked, accepted in wanted:
        corpus = whole.where(accepted)
        table = numbered.where(asked).toArrow().sort_by("_block")
        ends = np.flatnonzero(np.diff(table["_block"].to_numpy(), append=-1)) + 1
        table = table.drop_columns(["_block"])
        # Taken, since a slice would be sent with the whole table.
        sent = [table.take(pa.array(np.arange(lo, hi))) for lo, hi in zip([0, *ends[:-1]], ends)]
        parts.append(materialise(_searched(corpus, queries, sent, scorer, k, payload, filter_keys, missing_passes, floor)))
    return reduce(DataFrame.unionByName, parts)


def jobs_by_filter(
    rows: DataFrame, corpus: DataFrame, keys: tuple[str, ...], jobs: int, share: Column, missing_passes: bool = False
) -> list[tuple[Column, Column]] | None:
    """Per job (its queries, the corpus rows that any of them accepts). None if filters are no texts or whole numbers, or
    differ among too many queries."""
    plain = (T.StringType, T.LongType, T.IntegerType)
    if not keys or not all(isinstance(kind, plain) for c in keys for kind in (rows.schema[f"f_{c}"].dataType, corpus.schema[c].dataType)):
        return None
    names = [f"f_{c}" for c in keys]
    groups = rows.groupBy(*names).agg(F.count("*").alias("_n")).limit(FILTER_GROUPS + 1).collect()
    if len(groups) > FILTER_GROUPS:
        return None
    room = sum(g["_n"] for g in groups) / jobs
    out: list[list[tuple[Column, Column]]] = [[]]
    left = room
    for g in sorted(groups, key=lambda g: [(g[c] is None, str(g[c])) for c in names]):
        own = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(g[c])) for c in names])
        takes = [F.lit(True)]
        for c, name in zip(keys, names):
            if g[name] is not None:
                takes.append((F.col(c) == F.lit(g[name])) | (F.col(c).isNull() if missing_passes else F.lit(False)))
        done = 0
        while done < SHARES:
            if left < g["_n"] / SHARES and len(out) < jobs:
                out.append([])
                left = room
            some = SHARES - done if len(out) == jobs else min(SHARES - done, max(1, int(left * SHARES / g["_n"])))
            out[-1].append((own & (share >= done) & (share < done + some), reduce(lambda a, b: a & b, takes)))
            left -= some * g["_n"] / SHARES
            done += some
    return [tuple(reduce(lambda a, b: a | b, side) for side in zip(*parts)) for parts in out if parts]


def broadcast_topk(
    corpus: DataFrame, queries: DataFrame, scorer: ScorerFactory, k: int, payload: list[str],
    filter_keys: tuple[str, ...] = (), missing_passes: bool = False, floor: float = -np.inf,
) -> DataFrame:
    """Queries (already checked to be small) to every task; the corpus stays where it is."""
    return _searched(corpus, queries, [queries.toArrow()], scorer, k, payload, filter_keys, missing_passes, floor)


def _searched(
    corpus: DataFrame, queries: DataFrame, blocks: list[pa.Table], scorer: ScorerFactory, k: int, payload: list[str],
    filter_keys: tuple[str, ...], missing_passes: bool, floor: float,
) -> DataFrame:
    schema = _output_schema(corpus, queries, payload)
    arrow_schema = to_arrow_schema(schema)
    shared = [corpus.sparkSession.sparkContext.broadcast(block) for block in blocks]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b.value for b in shared]
        for number, found in _scan_blocks(batches, tables, scorer, filter_keys, missing_passes, k, payload, floor):
            yield from _emit(found, tables[number]["query_id"], arrow_schema).to_batches(max_chunksize=10_000)

    return best_per_query(corpus.mapInArrow(search, schema), payload[0], k)


def index_topk(
    tasks: int, corpus: DataFrame, queries: DataFrame, scorer: ScorerFactory, k: int, payload: list[str],
    filter_keys: tuple[str, ...] = (), missing_passes: bool = False, floor: float = -np.inf,
) -> DataFrame:
    """The corpus (already checked to be small) to every task, the queries dealt to so many tasks."""
    found = _output_schema(corpus, queries, payload)
    schema = T.StructType([*found.fields, T.StructField("rank", T.IntegerType())])
    arrow_schema = to_arrow_schema(schema)
    shared = corpus.sparkSession.sparkContext.broadcast(corpus.toArrow())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(payload[0], "ascending")], null_placement="at_start"))
        pieces = [p for batch in rows.to_batches() for p in _pieces(batch)]
        columns = rows.select(payload).combine_chunks()
        for batch in batches if pieces else ():
            if not batch.num_rows:
                continue
            block = pa.Table.from_batches([batch])
            own, allowed = scorer(block), AllowedValues(block, filter_keys, missing_passes)
            ready = [(own.prepare(p), p.num_rows, allowed.codes(p)) for p in pieces]
            for found in _ranked(ready, own, allowed if filter_keys else None, k, floor):
                query, score, row, rank = (np.concatenate(x) for x in zip(*found, strict=True))
                made = [block["query_id"].take(pa.array(query)), pa.array(score), *columns.take(pa.array(row)).columns, pa.array(rank)]
                yield from pa.Table.from_arrays(made, names=schema.names).cast(arrow_schema).to_batches()

    return queries.repartition(tasks, "query_id").mapInArrow(search, schema)


def _ranked(ready: list[tuple], scorer: Scorer, allowed: AllowedValues | None, k: int, floor: float) -> Iterator[list[tuple]]:
    """(query, scores, rows, ranks) of one query after the other, some queries at a time. Rows are in the order of their ids,
    so a stable order by score is the whole order."""
    starts = np.cumsum([0, *(n_rows for _, n_rows, _ in ready)])
    slab, out, held = max(1, (SCAN_CELLS >> 2) // int(starts[-1])), [], 0
    for lo in range(0, scorer.n, slab):
        hi = min(lo + slab, scorer.n)
        parts = []
        for prepared, _, codes in ready:
            scores, error = scorer.estimate(lo, hi, prepared)
            parts.append((scores if allowed is None else np.where(allowed.mask(lo, hi, codes), scores, -np.inf), error))
        for i in range(lo, hi):
            least = -np.inf
            if k < starts[-1]:  # no row below the k-th best, by as much as estimates may be off
                least = np.partition(np.concatenate([scores[i - lo] - error for scores, error in parts]), starts[-1] - k)[starts[-1] - k]
            exact, rows = [], []
            for (prepared, n_rows, _), start, (scores, error) in zip(ready, starts, parts):
                scores = scores[i - lo]
                wanted = (scores >= least - error) & (scores > floor - error) & (scores > -np.inf)
                whole = bool(wanted.all())
                at = np.arange(n_rows) if whole else np.flatnonzero(wanted)
                for first in range(0, len(at), ROWS_AT_ONCE):
                    some = slice(first, min(first + ROWS_AT_ONCE, n_rows)) if whole else at[first : first + ROWS_AT_ONCE]
                    exact.append(scorer.exact(np.array([i]), some, prepared, scores[some]))
                rows.append(at + start)
            if not exact:
                continue
            exact, rows = np.concatenate(exact), np.concatenate(rows)
            if not (exact > floor).all():
                exact, rows = exact[exact > floor], rows[exact > floor]
            order = np.argsort(-exact, kind="stable")[:k]
            out.append((np.full(len(order), i), exact[order], rows[order], np.arange(1, len(order) + 1, dtype=np.int32)))
            held += len(order)
            if held >= RANKED_AT_ONCE:
                yield out
                out, held = [], 0
    if out:
        yield out


def grid_topk(
    corpus: DataFrame, queries: DataFrame, scorer: ScorerFactory, k: int, payload: list[str],
    filter_keys: tuple[str, ...] = (), missing_passes: bool = False, floor: float = -np.inf,
    cell: str | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Blocks of both sides meet in one task each; see ``grid_candidates``."""
    found = grid_candidates(corpus, queries, scorer, k, payload, filter_keys, missing_passes, floor, cell, block_bytes)
    return best_per_query(found, payload[0], k)


def grid_candidates(
    corpus: DataFrame, queries: DataFrame, scorer: ScorerFactory, k: int, payload: list[str],
    filter_keys: tuple[str, ...] = (), missing_passes: bool = False, floor: float = -np.inf,
    cell: str | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k best rows of each block for each of its queries, per cell if ``cell`` names a column both sides have.

    Block counts come from the measured bytes of each cell, so no task gets more than about ``block_bytes`` of either
    side however the rows are spread over cells. Cells must be few (centroids, hash buckets): their sizes are read by
    the driver.
    """
    keys = [cell] if cell else []

    def blocks(df: DataFrame, name: str) -> DataFrame:
        sizes = df.groupBy(*keys).agg(F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("b"))
        return sizes.select(*keys, F.greatest(F.lit(1), F.ceil(F.col("b") / block_bytes)).cast("int").alias(name))

    if cell:
        counts = blocks(corpus, "_rows").join(blocks(queries, "_cols"), cell)
        # As many rows as cells; written down so that both sides read the same.
        grid = corpus.sparkSession.createDataFrame(counts.collect(), counts.schema)
    else:
        n_rows, n_cols = blocks(corpus, "_rows").first()["_rows"], blocks(queries, "_cols").first()["_cols"]

    def placed(df: DataFrame) -> DataFrame:
        if cell:
            return df.join(F.broadcast(grid), cell)
        return df.withColumn("_rows", F.lit(n_rows)).withColumn("_cols", F.lit(n_cols))

    def assigned(df: DataFrame, id_col: str, own: str, other: str, own_key: str, other_key: str) -> DataFrame:
        rows = placed(df).withColumn(own_key, F.pmod(F.xxhash64(id_col), F.col(own)).cast("int"))
        return rows.withColumn(other_key, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_rows", "_cols")

    left = assigned(corpus, payload[0], "_rows", "_cols", "_r", "_c")
    right = assigned(queries, "query_id", "_cols", "_rows", "_c", "_r")
    # Fresh column identities: queries may come from the corpus table itself.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    schema = _output_schema(corpus, queries, payload)
    arrow_schema = to_arrow_schema(schema)

    def search(rows: pa.Table, block: pa.Table) -> pa.Table:
        if not rows.num_rows or not block.num_rows:
            return arrow_schema.empty_table()
        found = _scan(rows.to_batches(max_chunksize=10_000), block, scorer, filter_keys, missing_passes, k, payload, floor)
        return pa.concat_tables([arrow_schema.empty_table(), *(_emit(x, block["query_id"], arrow_schema) for x in found)])

    by = [*keys, "_r", "_c"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, schema)
