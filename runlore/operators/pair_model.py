"""A pair scorer that is learned: which of two texts answers a query better, from how they share its words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.functions import text as tx
from runlore.operators.lexical import TermStatistics, query_terms, weighted_terms
from runlore.session import materialise, spread

#: What is known of a pair: weight of the query's terms that the text has; shares of the query's runs of two and of three
#: words that stand in the text; how long the text is beside the query.
FEATURES = ("coverage", "pairs", "triples", "length")


def runs(words: Column, n: int) -> Column:
    """Distinct runs of ``n`` words, each as one string."""
    last = F.size(words) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))))


def share(asked: Column, found: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, found)), F.size(asked)), F.lit(0.0))


@dataclass(frozen=True)
class LearnedPairs:
    """``weights``: one per feature, in ``FEATURES`` order; ``weighted``: the queries' terms once ``fit`` has seen them."""

    weights: tuple[float, ...]
    weighted: DataFrame | None = None

    def fit(self, queries: DataFrame, stats: TermStatistics) -> LearnedPairs:
        return LearnedPairs(self.weights, query_weights(queries, stats))

    def raw(self, candidates: DataFrame, queries: DataFrame) -> DataFrame:
        rows = pair_features(candidates, queries, self.weighted)
        total = F.lit(0.0)
        for name, w in zip(FEATURES, self.weights, strict=True):
            total = total + F.col(f"_{name}") * float(w)
        return rows.withColumn("raw", total).drop(*[f"_{n}" for n in FEATURES])

    @classmethod
    def learn(cls, judged: DataFrame, queries: DataFrame, stats: TermStatistics, decay: float = 1e-3) -> LearnedPairs:
        """From candidates (query_id, chunk_id, text, good): within each query every good one should come before every
        other one. Pairs are as many as a query's good candidates times its others, so both must be few, as a cut at the
        first ranks makes them."""
        rows = materialise(pair_features(judged, queries, query_weights(queries, stats)).select("query_id", "good", *[f"_{n}" for n in FEATURES]))
        good, other = rows.where("good"), rows.where("NOT good")
        better = good.select("query_id", F.array(*[f"_{n}" for n in FEATURES]).alias("g"))
        worse = other.select("query_id", F.array(*[f"_{n}" for n in FEATURES]).alias("o"))
        apart = better.join(worse, "query_id").select(F.zip_with("g", "o", lambda x, y: x - y).alias("d"))
        both = apart.select("d", F.lit(1.0).alias("label")).unionByName(apart.select(F.transform("d", lambda x: -x).alias("d"), F.lit(0.0).alias("label")))
        both = materialise(both.withColumn("features", array_to_vector("d")).drop("d"))
        if both.isEmpty():
            raise ValueError("no query has both a good candidate and another one")
        model = LogisticRegression(fitIntercept=False, standardization=True, regParam=decay, maxIter=50).fit(both)
        return cls(tuple(float(x) for x in np.asarray(model.coefficients.toArray())))


def query_weights(queries: DataFrame, stats: TermStatistics) -> DataFrame:
    return materialise(weighted_terms(query_terms(queries), stats).select("query_id", F.arrays_zip("terms", "idfs").alias("query_terms")))


def pair_features(candidates: DataFrame, queries: DataFrame, weighted: DataFrame) -> DataFrame:
    """Candidates with a column ``_<feature>`` for each of ``FEATURES``, from their whole texts."""
    asked = queries.select("query_id", tx.terms(F.coalesce(F.col("text"), F.lit(""))).alias("_asked")).join(weighted, "query_id", "left")
    asked = asked.select("query_id", "query_terms", F.size("_asked").alias("_n"), *[runs(F.col("_asked"), n).alias(f"_asked{n}") for n in (2, 3)])
    rows = spread(candidates, "query_id", "chunk_id").withColumn("_words", tx.terms(F.coalesce(F.col("text"), F.lit(""))))
    joined = rows.join(asked, "query_id")

    def weight(pairs: Column) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda acc, t: acc + t.idfs)

    terms = F.col("query_terms")
    found = tx.bind(F.array_intersect(terms.terms, F.col("_words")), lambda has: F.filter(terms, lambda t: F.array_contains(has, t.terms)))
    return joined.select(
        *candidates.columns,
        F.coalesce(F.try_divide(weight(found), weight(terms)), F.lit(0.0)).alias("_coverage"),
        share(F.col("_asked2"), runs(F.col("_words"), 2)).alias("_pairs"), share(F.col("_asked3"), runs(F.col("_words"), 3)).alias("_triples"),
        F.log1p(F.coalesce(F.try_divide(F.size("_words"), F.col("_n")), F.lit(0.0))).alias("_length"))
