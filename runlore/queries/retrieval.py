"""Queries over lexical and dense retrieval. The benchmark passages are the queries, the documents the corpus."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.operators import chunking, lexical, rerank as rr
from runlore.operators.lexical import TermStatistics
from runlore.operators.pair_model import LearnedPairs
from runlore.operators.skew import bounded_broadcast
from runlore.plans.evaluation import ablation
from runlore.plans.index_build import KnowledgeBase, knowledge_base, lexical_base
from runlore.plans.retrieval import retrieve, with_chunks
from runlore.queries.base import bm25_sql, chunk_sql, cosine_sql, query, rerank_sql, table, texts
from runlore.queries.documents import DOC_SQL, doc_rows
from runlore.session import materialise
from runlore.settings import ChunkSettings, RetrievalSettings, Settings

LEXICAL = RetrievalSettings(dense=False, filter_keys=())
DENSE = RetrievalSettings(filter_keys=())

QUERY_SQL = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"
CORPUS_SQL = "corpus AS (SELECT doc_id AS id, text FROM documents)"


def passages(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def corpus(spark, sf) -> DataFrame:
    return texts(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text")


def chunk_corpus(spark, sf) -> DataFrame:
    """Sliding-window chunks of all documents."""
    return chunking.chunk_with(doc_rows(spark, sf), chunking.sliding_windows(), "sliding_window")


@query(
    "bm25_topk",
    f"WITH {CORPUS_SQL}, {QUERY_SQL}, {bm25_sql('b', 'corpus', 'queries', 10)} SELECT query_id, id AS chunk_id, round(s, 6) AS score, rn AS rank FROM b_top",
)
def bm25_topk(spark, sf):
    found = lexical.bm25(corpus(spark, sf), passages(spark, sf), 10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    "bm25_topk_pre_filter",
    f"""WITH {CORPUS_SQL}, {QUERY_SQL}, {bm25_sql('b', 'corpus', 'queries', 0)},
    kept AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rn
      FROM b_s JOIN documents ON doc_id = id WHERE source = 'src' || (query_id % 20))
    SELECT query_id, id AS chunk_id, round(s, 6) AS score, rn AS rank FROM kept WHERE rn <= 10""",
)
def bm25_topk_pre_filter(spark, sf):
    """Only documents of the wanted source compete."""
    rows = texts(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text", "source")
    asked = passages(spark, sf).withColumn("f_source", F.concat(F.lit("src"), F.col("query_id") % 20))
    found = lexical.bm25(rows, asked, 10, filter_keys=("source",))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def first_candidates(spark, sf) -> tuple[DataFrame, lexical.TermStatistics]:
    """Ten best documents per passage with their text, and the statistics of the documents."""
    rows = corpus(spark, sf)
    stats = lexical.term_statistics(rows)
    found = materialise(lexical.bm25(rows, passages(spark, sf), 10, stats=stats))
    return with_chunks(found, rows, ("text",)), stats


_RERANKED = f"WITH {CORPUS_SQL}, {QUERY_SQL}, {bm25_sql('b', 'corpus', 'queries', 10)}, {rerank_sql('r1', 'b_top', 'b')}"


@query(
    "reranked_candidates",
    f"""{_RERANKED} SELECT query_id, id AS chunk_id, round(score, 6) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM r1""",
)
def reranked_candidates(spark, sf):
    asked = passages(spark, sf)
    candidates, stats = first_candidates(spark, sf)
    found = rr.rerank(candidates, asked, rr.TermCoverage().fit(asked, stats))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def relative_length():
    """A pair model of the user's: what a worker loads once, from pairs of texts to scores."""
    return lambda pairs: np.array([(len(q) - len(t)) / (len(q) + len(t)) for q, t in pairs])


@query(
    "pair_function_scores",
    f"""WITH {CORPUS_SQL}, {QUERY_SQL}, {bm25_sql('b', 'corpus', 'queries', 10)},
    scored AS (SELECT query_id, b_top.id, 1 / (1 + exp(-((length(q.text) - length(d.text))::DOUBLE / (length(q.text) + length(d.text))))) AS s
      FROM b_top JOIN queries q USING (query_id) JOIN corpus d ON d.id = b_top.id)
    SELECT query_id, id AS chunk_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM scored""",
)
def pair_function_scores(spark, sf):
    found, stats = first_candidates(spark, sf)
    asked = passages(spark, sf)
    scored = rr.rerank(found, asked, rr.PairFunction(relative_length, batch_size=16).fit(asked, stats))
    return scored.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_SPARSE = """pass1 AS (SELECT * FROM r1 WHERE score >= 0.45),
sparse AS (SELECT query_id, text FROM queries LEFT JOIN (SELECT query_id, count(*) AS n FROM pass1 GROUP BY query_id) USING (query_id) WHERE coalesce(n, 0) < 3)"""


@query("sparse_queries", f"{_RERANKED}, {_SPARSE} SELECT query_id FROM sparse")
def sparse_queries(spark, sf):
    asked = passages(spark, sf)
    candidates, stats = first_candidates(spark, sf)
    scored = rr.rerank(candidates, asked, rr.TermCoverage().fit(asked, stats))
    return rr.sparse_queries(asked, scored.where(F.col("score") >= 0.45), 3).select("query_id")


def _passages_sql(candidates: str) -> str:
    return f"""ptf AS (SELECT c.query_id, t, sum(tf) AS tf FROM {candidates} c JOIN b_tf USING (id) GROUP BY ALL),
pw AS (SELECT query_id, t, row_number() OVER (PARTITION BY query_id ORDER BY round(tf * ln(1 + (n - df + 0.5) / (df + 0.5)), 9) DESC, t) AS place
  FROM ptf JOIN b_df USING (t), b_st),
pas AS (SELECT query_id, string_agg(t, ' ' ORDER BY place) AS passage FROM pw WHERE place <= 20 GROUP BY query_id)"""


@query(
    "expanded_queries",
    f"""WITH {CORPUS_SQL}, {QUERY_SQL}, {bm25_sql('b', 'corpus', 'queries', 10)}, {_passages_sql('b_top')}
    SELECT query_id, coalesce(text || chr(10) || chr(10) || passage, text) AS text FROM queries LEFT JOIN pas USING (query_id)""",
)
def expanded_queries(spark, sf):
    found = rr.feedback_passages(*first_candidates(spark, sf), 20)
    return rr.expand(passages(spark, sf), found).select("query_id", "text")


_RETRIEVAL = f"""WITH {DOC_SQL},{chunk_sql('ch', 'src', 'sliding_window')},
corpus AS (SELECT printf('%s_chunk_%04d', id, i) AS id, text FROM ch), {QUERY_SQL},
{bm25_sql('b', 'corpus', 'queries', 10)}, {rerank_sql('r1', 'b_top', 'b')}, {_SPARSE},
asked AS (SELECT b_top.* FROM b_top SEMI JOIN sparse USING (query_id)), {_passages_sql('asked')},
expanded AS (SELECT query_id, coalesce(text || chr(10) || chr(10) || passage, text) AS text FROM sparse LEFT JOIN pas USING (query_id)),
{bm25_sql('e', 'corpus', 'expanded', 10)}, {rerank_sql('r2', 'e_top', 'b')},
merged AS (SELECT query_id, id, max(round(score, 9)) AS score FROM (SELECT * FROM pass1 UNION ALL SELECT * FROM r2 WHERE score >= 0.45) GROUP BY query_id, id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM merged)"""


@query("lexical_retrieval", f"{_RETRIEVAL} SELECT query_id, id AS chunk_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5")
def lexical_retrieval(spark, sf):
    """The whole path over chunks: search, re-rank, threshold, expansion of the sparse queries, cut."""
    found = retrieve(passages(spark, sf), lexical_base(chunk_corpus(spark, sf)), LEXICAL)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


UNRANKED = 60.0
_UNRANKED = f"""WITH {DOC_SQL},{chunk_sql('ch', 'src', 'sliding_window')},
corpus AS (SELECT printf('%s_chunk_%04d', id, i) AS id, text FROM ch), {QUERY_SQL}, {bm25_sql('b', 'corpus', 'queries', 10)},
pass1 AS (SELECT query_id, id, s FROM b_top WHERE s >= {UNRANKED}),
sparse AS (SELECT query_id, text FROM queries LEFT JOIN (SELECT query_id, count(*) AS n FROM pass1 GROUP BY query_id) USING (query_id) WHERE coalesce(n, 0) < 3),
asked AS (SELECT b_top.* FROM b_top SEMI JOIN sparse USING (query_id)), {_passages_sql('asked')},
expanded AS (SELECT query_id, coalesce(text || chr(10) || chr(10) || passage, text) AS text FROM sparse LEFT JOIN pas USING (query_id)),
{bm25_sql('e', 'corpus', 'expanded', 10)},
merged AS (SELECT query_id, id, max(s) AS s FROM (SELECT * FROM pass1 UNION ALL SELECT query_id, id, s FROM e_top WHERE s >= {UNRANKED}) GROUP BY query_id, id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM merged)"""


@query("retrieval_without_rerank", f"{_UNRANKED} SELECT query_id, id AS chunk_id, round(s, 6) AS score, rank FROM ranked WHERE rank <= 5")
def retrieval_without_rerank(spark, sf):
    """A pair that both rounds find has two scores and keeps the better one."""
    settings = replace(LEXICAL, rerank=False, threshold=UNRANKED)
    found = retrieve(passages(spark, sf), lexical_base(chunk_corpus(spark, sf)), settings)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("dense_retrieval")
def dense_retrieval(spark, sf):
    """The whole path with vectors of the default featurizer."""
    kb = knowledge_base(doc_rows(spark, sf))
    found = retrieve(passages(spark, sf), kb, DENSE)
    return found.select("query_id", "chunk_id", "document_id", F.round("score", 6).alias("score"), "rank")


class GivenVectors:
    """A featurizer of queries whose vectors are there already."""

    model, dimensions = "given", 64

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors

    def fit(self, rows: DataFrame, text_col: str = "text") -> GivenVectors:
        return self

    def transform(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        return rows.join(self.vectors.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")


@query(
    "dense_retrieval_given_vectors",
    f"WITH {cosine_sql(10, 'a.label = b.label')} SELECT query_id, vec_id AS chunk_id, round(s, 4) AS score, rank FROM found WHERE s >= 0.2 AND rank <= 5",
)
def dense_retrieval_given_vectors(spark, sf):
    """The dense path with given vectors: search under a filter, threshold, cut."""
    rows = table(spark, sf, "embeddings")
    named = rows.withColumn("chunk_id", F.col("vec_id"))
    chunks = named.select(
        "chunk_id", F.concat(F.lit("doc_"), "vec_id").alias("document_id"), F.lit("alert").alias("document_type"),
        F.lit("t").alias("title"), F.lit("x").alias("text"), "label")
    kb = KnowledgeBase(chunks, named.select("chunk_id", "label", "embedding"), GivenVectors(rows), TermStatistics(None, 0, 0.0))
    asked = rows.select(F.col("vec_id").alias("query_id"), F.lit("x").alias("text"), F.col("label").alias("f_label"))
    settings = RetrievalSettings(threshold=0.2, rerank=False, expansion_enabled=False, filter_keys=("label",))
    return retrieve(asked, kb, settings).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


SHINGLE = 8
FIRST_WORDS = 10_000


def containing_documents(spark, sf) -> DataFrame:
    """(item_id, doc_id) of the documents that hold a benchmark passage word for word.

    Pairs come from an equi join on the passage's first words, so only documents that share them are compared.
    """

    def flat(c):
        return F.regexp_replace(c, r"\s+", " ")

    items = table(spark, sf, "benchmark").select("item_id", flat("text").alias("passage"))
    items = items.withColumn("start", F.array_join(F.slice(F.split("passage", " "), 1, SHINGLE), " "))
    rows = texts(spark, sf).select("doc_id", flat("text").alias("body")).withColumn("w", F.split("body", " "))
    n = F.greatest(F.lit(1), F.size("w") - SHINGLE + 1)
    places = F.sequence(F.lit(1), n)
    # Runs are put together only where a word stands that some passage begins with, as long as there are few such words.
    first = items.select(F.split("start", " ")[0].alias("w")).where("w IS NOT NULL").distinct().limit(FIRST_WORDS + 1).collect()
    if len(first) <= FIRST_WORDS:
        known = [r.w for r in first]
        places = F.filter(places, lambda i: F.element_at("w", i).isin(known))
    starts = F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice("w", i, SHINGLE), " ")))
    # Only runs that begin a passage leave a task; then each passage meets the documents that hold its beginning.
    wanted = bounded_broadcast(items.select("start").distinct())
    hits = rows.select("doc_id", F.explode_outer(starts).alias("start")).join(wanted, "start", "left_semi")
    pairs = hits.join(items.select("item_id", "start"), "start").select("item_id", "doc_id").distinct()
    verified = pairs.join(rows.select("doc_id", "body"), "doc_id").join(items.select("item_id", "passage"), "item_id")
    return verified.where(F.col("body").contains(F.col("passage"))).select("item_id", "doc_id")


def name_sources(prompt_rows: DataFrame) -> DataFrame:
    """Replies that name the sources of the prompt's passages in order: a stand-in for a model, so that what is
    measured is the retrieval."""
    sources = F.regexp_extract_all("user_message", F.lit(r"(?m)^Source: (.*)$"), 1)
    causes = F.transform(sources, lambda s: F.struct(s.alias("hypothesis"), F.lit("1.0").alias("confidence")))
    return prompt_rows.select("incident_id", F.to_json(F.struct(causes.alias("root_causes"))).alias("text"))


@query("ablation_metrics")
def ablation_metrics(spark, sf):
    """Evaluation of every configuration: passages as incidents, the document that holds them as the label."""
    truth = containing_documents(spark, sf).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    samples = materialise(
        table(spark, sf, "benchmark").join(truth, "item_id").select(
            F.col("item_id").cast("string").alias("incident_id"),
            F.substring_index("text", ".", 1).alias("title"),
            F.col("text").alias("description"),
            F.lit("").alias("service"),
            F.lit("P3").alias("priority"),
            F.lit("").alias("environment"),
            F.lit("").alias("error_message"),
            F.concat(F.lit("doc_"), "doc_id").alias("ground_truth_root_cause"),
        )
    )
    rows = materialise(doc_rows(spark, sf).withColumn("title", F.col("document_id")))
    kb = knowledge_base(rows)
    # One window per document: larger than any text.
    widest = rows.agg(F.max("word_count")).first()[0] or 1
    whole = knowledge_base(
        rows.withColumn("document_type", F.lit("documentation")), Settings(chunks=ChunkSettings(size=max(widest, 1), overlap=0))
    )
    out = ablation(samples, kb, whole, name_sources)
    return out.select("config", "accuracy", "precision_at_1", "recall_at_3", "samples")


@query("learned_pairs_precision")
def learned_pairs_precision(spark, sf):
    """Share of passages whose first candidate holds them: by the first search, by term coverage, and by a scorer learned
    on the other half of the passages."""
    rows, asked = corpus(spark, sf), passages(spark, sf)
    held = materialise(containing_documents(spark, sf).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.lit(True).alias("good")))
    stats = lexical.term_statistics(rows)
    asked = materialise(asked.join(held.select("query_id").distinct(), "query_id", "left_semi").withColumn("half", F.pmod(F.xxhash64("query_id"), F.lit(2))))
    found = materialise(with_chunks(materialise(lexical.bm25(rows, asked, 10, stats=stats)), rows, ("text",)))
    judged = materialise(found.join(held, ["query_id", "chunk_id"], "left").withColumn("good", F.coalesce("good", F.lit(False))))
    halves = asked.select("query_id", "half")
    parts = []

    def first_of(ranked: DataFrame, scorer: str, half: DataFrame) -> None:
        first = ranked.where("rank = 1").join(half.select("query_id"), "query_id", "left_semi").join(held, ["query_id", "chunk_id"], "left")
        parts.append(first.agg(F.lit(scorer).alias("scorer"), F.count("*").alias("n"), F.count("good").alias("right")))

    for test in (0, 1):
        learn_from, half = judged.join(halves.where(F.col("half") != test), "query_id", "left_semi"), halves.where(F.col("half") == test)
        learned = LearnedPairs.learn(learn_from, asked, stats)
        mine = found.join(half, "query_id", "left_semi")
        first_of(mine, "search", half)
        first_of(rr.rerank(mine, asked, rr.TermCoverage().fit(asked, stats)), "coverage", half)
        first_of(rr.rerank(mine, asked, learned.fit(asked, stats)), "learned", half)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("scorer").agg(F.sum("n").alias("passages"), (F.sum("right") / F.sum("n")).alias("precision_at_1"))
