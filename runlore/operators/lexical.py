"""Lexical scoring: term statistics of the query vocabulary and Okapi BM25 top-k."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.functions import text as tx
from runlore.operators.skew import bounded_broadcast, join_hot
from runlore.operators.topk import BROADCAST_BYTES, topk
from runlore.session import materialise

K1 = 1.2
B = 0.75
POSTINGS_AT_ONCE = 1 << 21
#: A term goes into the matrix product if more than one of so many pairs of a query and a text have it; cells of its sides.
PRODUCT_SHARE, PRODUCT_CELLS = 64, 1 << 22


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of the query texts."""
    rows = queries.select("query_id", F.explode_outer(tx.terms(F.col("text"))).alias("term")).where("term is not null")
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


@dataclass(frozen=True)
class TermStatistics:
    """(term, df) of a vocabulary, with the number of texts and their mean length in terms."""

    frequencies: DataFrame
    n: int
    mean_length: float


def term_statistics(corpus: DataFrame, vocabulary: DataFrame | None = None) -> TermStatistics:
    """One pass over the corpus, for all its terms or for those of ``vocabulary``; the result is materialised."""
    return statistics_of(materialise(term_counts(corpus, vocabulary)))


def term_counts(corpus: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(term, df, length). Every text also yields an empty term that carries its length, so the totals come out of the
    same aggregation. Hot terms are folded before the shuffle. Counts of two sets of texts add up."""
    # The size is taken before the array is exploded, so that no row of a term carries the array along.
    tokens = corpus.select(tx.terms(F.coalesce("text", F.lit(""))).alias("t")).select("t", F.size("t").alias("len"))
    seen = tokens.select("len", F.explode_outer(F.array_append(F.array_distinct("t"), F.lit(""))).alias("term"))
    if vocabulary is not None:
        wanted = vocabulary.select("term").distinct()
        empty = wanted.sparkSession.createDataFrame([("",)], "term string")
        seen = seen.join(bounded_broadcast(wanted.union(empty), 1_000_000), "term", "left_semi")
    length = F.sum(F.when(F.col("term") == "", F.col("len")))
    return seen.groupBy("term").agg(F.count("*").alias("df"), length.alias("length"))


def statistics_of(counted: DataFrame) -> TermStatistics:
    """Statistics from written counts."""
    total = counted.where(F.col("term") == "").first()
    n, length = (total["df"], total["length"]) if total else (0, 0)
    return TermStatistics(counted.where(F.col("term") != "").select("term", "df"), n, length / n if n else 0.0)


def idf(df, n: int):
    """Okapi inverse document frequency, never negative."""
    return F.log1p((F.lit(float(n)) - df + 0.5) / (df + 0.5))


def weighted_terms(terms: DataFrame, stats: TermStatistics) -> DataFrame:
    """(query_id, terms, idfs, weights): the query's terms in term order. A term the corpus lacks has frequency 0."""
    known = stats.frequencies.join(terms.select("term").distinct(), "term", "left_semi")
    with_df = join_hot(terms, known, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rows = with_df.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("term", idf(F.col("df"), stats.n).alias("idf"), "qtf"))).alias("t")
    )
    return rows.select(
        "query_id",
        F.col("t.term").alias("terms"),
        F.col("t.idf").alias("idfs"),
        F.transform("t", lambda x: x.idf * x.qtf).alias("weights"),
    )


class BM25Scorer:
    """Sparse scoring in a task: the rows' term counts, restricted to the query vocabulary, against the queries'
    weights. Only the matrix of scores exists at once, never the (query, term, row) triples of a hot term: terms that many
    queries and rows have are a matrix product, the others are added posting by posting."""

    rows_alike = False  # their terms are counted by the vocabulary of the queries

    def __init__(self, queries: pa.Table, mean_length: float, k1: float = K1, b: float = B):
        self.mean_length, self.k1, self.b = mean_length, k1, b
        self.n = queries.num_rows
        lists = queries["terms"].combine_chunks()
        owner = np.repeat(np.arange(self.n), pc.list_value_length(lists).to_numpy())
        encoded = lists.flatten().dictionary_encode()
        self.vocabulary = encoded.dictionary
        # Postings in (term, query) order, found by one sorted key.
        key = encoded.indices.to_numpy().astype(np.int64) * self.n + owner
        order = np.argsort(key)
        self.key, self.owner = key[order], owner[order]
        self.weight = queries["weights"].combine_chunks().flatten().to_numpy()[order]

    def prepare(self, batch):
        lists = batch["terms"]
        length = pc.list_value_length(lists).to_numpy().astype(np.float64)
        row = np.repeat(np.arange(len(lists)), length.astype(np.int64))
        code = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.vocabulary), -1).to_numpy()
        known = code >= 0
        cells, count = np.unique(row[known] * max(1, len(self.vocabulary)) + code[known], return_counts=True)
        row, code = np.divmod(cells, max(1, len(self.vocabulary)))
        damp = self.k1 * (1 - self.b + self.b * length[row] / self.mean_length)
        rows_of = np.bincount(code, minlength=len(self.vocabulary))
        return row, code, count * (self.k1 + 1) / (count + damp), len(lists), rows_of

    def _product(self, hot, start, n, lo, hi, row, code, part, n_rows) -> np.ndarray:
        """What the hot terms add to the scores: the queries' weights times the rows' parts."""
        place = np.full(len(self.vocabulary), -1)
        place[hot] = np.arange(len(hot))
        own = place[code] >= 0
        parts, weights = np.zeros((len(hot), n_rows)), np.zeros((hi - lo, len(hot)))
        parts[place[code[own]], row[own]] = part[own]
        posting = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        weights[self.owner[posting] - lo, np.repeat(np.arange(len(hot)), n)] = self.weight[posting]
        return (weights @ parts).reshape(-1)

    def estimate(self, lo, hi, prepared):
        row, code, part, n_rows, rows_of = prepared
        # The postings of a term that fall to these queries, looked up once a term and not once for each of its rows.
        terms = np.arange(len(self.vocabulary)) * self.n
        start, stop = np.searchsorted(self.key, terms + lo), np.searchsorted(self.key, terms + hi)
        pairs = (stop - start) * rows_of
        hot = np.flatnonzero(pairs * PRODUCT_SHARE > (hi - lo) * n_rows)
        hot = hot[np.argsort(-pairs[hot], kind="stable")][: PRODUCT_CELLS // (hi - lo + n_rows)]
        scores = np.zeros((hi - lo) * n_rows)
        if len(hot):
            scores = self._product(hot, start[hot], (stop - start)[hot], lo, hi, row, code, part, n_rows)
            stop[hot] = start[hot]
        hit = (stop > start)[code]
        row, code, part = row[hit], code[hit], part[hit]
        first = start[code]
        reach = stop[code] - first
        ends = np.cumsum(reach)
        at = 0
        while at < len(row):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + POSTINGS_AT_ONCE, side="right")))
            n = reach[at:stop]
            posting = np.repeat(first[at:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = (self.owner[posting] - lo) * n_rows + np.repeat(row[at:stop], n)
            value = self.weight[posting] * np.repeat(part[at:stop], n)
            scores += np.bincount(cell, weights=value, minlength=len(scores))
            at = stop
        # Scores equal to nine decimals tie, so the order of the sum does not decide between copies of a text.
        return np.round(scores, 9).reshape(hi - lo, n_rows), 0.0

    def exact(self, queries, rows, prepared, estimates):
        return estimates


def bm25(
    corpus: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "chunk_id", carry: tuple[str, ...] = (),
    stats: TermStatistics | None = None, broadcast_bytes: int = BROADCAST_BYTES, filter_keys: tuple[str, ...] = (),
    missing_passes: bool = False,
) -> DataFrame:
    """(query_id, id, score, rank) of the k best texts per query; texts that share no term with it are not results.

    A null text has no terms. With ``filter_keys`` the queries carry ``f_<key>`` columns, and only rows that satisfy them compete.

    ``stats``: statistics of the corpus if they are there already, else they are taken for the queries' terms.
    """
    terms = materialise(query_terms(queries))
    stats = stats or term_statistics(corpus, terms)
    weighted = weighted_terms(terms, stats).select("query_id", "terms", "weights")
    if filter_keys:
        weighted = weighted.join(queries.select("query_id", *[f"f_{k}" for k in filter_keys]), "query_id")
    weighted = materialise(weighted)
    payload = list(dict.fromkeys([id_col, *carry, *filter_keys]))
    rows = corpus.select(*payload, tx.terms(F.coalesce("text", F.lit(""))).alias("terms"))
    scorer = partial(BM25Scorer, mean_length=stats.mean_length or 1.0)
    found = topk(rows, weighted, scorer, k, payload, filter_keys, missing_passes, floor=0.0, broadcast_bytes=broadcast_bytes, costly=True)
    return found.select("query_id", *payload, "score", "rank")
