"""Queries over stored indexes: each builds its index from the tables, then searches it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.operators import ann, lookup, postings, search as se
from runlore.operators.partitioned_table import PartitionedTable
from runlore.operators.quantised import CodedTable, Codes, search_coded, write_coded
from runlore.operators.vector_blocks import VectorBlocks, search_blocks, write_blocks
from runlore.plans.index_build import stored_base
from runlore.plans.retrieval import retrieve
from runlore.queries.base import SQL, query, table, texts
from runlore.queries.indexing import text_chunks
from runlore.queries.retrieval import LEXICAL, chunk_corpus, passages
from runlore.queries.vectors import K, as_queries, vectors
from runlore.session import scratch_path

#: Cells of the coded vectors, how many of them a query probes, bytes of a code, and candidates per result.
CODED_CELLS, CODED_PROBES, CODE_BYTES, SURVIVORS = 16, 14, 16, 10


def document_index(spark, sf) -> postings.Index:
    """Postings of all documents, in two segments: the English ones, then the others."""
    rows = texts(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text", "source", F.col("lang").eqNullSafe(F.lit("en")).alias("english"))
    root = scratch_path(spark, "postings")
    postings.append(spark, root, rows.where("english"), carry=("source",))
    return postings.append(spark, root, rows.where("NOT english"), carry=("source",))


def _scores(found: DataFrame) -> DataFrame:
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("postings_topk", SQL["bm25_topk"])
def postings_topk(spark, sf):
    return _scores(postings.search(document_index(spark, sf), passages(spark, sf), 10))


@query("postings_topk_pre_filter", SQL["bm25_topk_pre_filter"])
def postings_topk_pre_filter(spark, sf):
    asked = passages(spark, sf).withColumn("f_source", F.concat(F.lit("src"), F.col("query_id") % 20))
    return _scores(postings.search(document_index(spark, sf), asked, 10, ("source",)))


@query("stored_retrieval", SQL["lexical_retrieval"])
def stored_retrieval(spark, sf):
    """The whole lexical path over stored postings and bucketed chunks."""
    kb = stored_base(chunk_corpus(spark, sf), scratch_path(spark, "stored-base"))
    return _scores(retrieve(passages(spark, sf), kb, LEXICAL))


@query("postings_blocks_skipped")
def postings_blocks_skipped(spark, sf):
    """(query, block) pairs that share a term, and how many of them the bounds leave to be scored."""
    return postings.block_report(document_index(spark, sf), passages(spark, sf))


def vector_blocks(spark, sf) -> VectorBlocks:
    return write_blocks(vectors(spark, sf), scratch_path(spark, "blocks"), id_col="vec_id", carry=("label",))


def _found(found: DataFrame) -> DataFrame:
    return found.select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


@query("vector_topk_blocks", SQL["vector_topk"])
def vector_topk_blocks(spark, sf):
    return _found(search_blocks(vector_blocks(spark, sf), as_queries(spark, sf), K)[0])


@query("vector_topk_blocks_pre_filter", SQL["vector_topk_pre_filter"])
def vector_topk_blocks_pre_filter(spark, sf):
    return _found(search_blocks(vector_blocks(spark, sf), as_queries(spark, sf, F.col("label")), K)[0])


@query("vector_blocks_skipped")
def vector_blocks_skipped(spark, sf):
    """How many (query, block) pairs the bounds leave out, for the nearest one and the nearest ten."""
    stored, wanted = vector_blocks(spark, sf), as_queries(spark, sf)
    pairs = stored.heads().count() * wanted.count()
    parts = []
    for k in (1, K):
        _, blocks = search_blocks(stored, wanted, k)
        scored = blocks.agg(F.coalesce(F.sum(F.size("asked")), F.lit(0)).alias("scored"))
        parts.append(scored.select(F.lit(k).alias("k"), F.lit(pairs).alias("pairs"), "scored", (1 - F.col("scored") / pairs).alias("skipped_share")))
    return parts[0].unionByName(parts[1])


def coded_vectors(spark, sf) -> CodedTable:
    rows = vectors(spark, sf)
    codes = Codes.fit(rows, CODED_CELLS, CODE_BYTES, "vec_id")
    return write_coded(rows, scratch_path(spark, "coded"), codes, "vec_id", ("label",))


@query("vector_topk_coded")
def vector_topk_coded(spark, sf):
    return _found(search_coded(coded_vectors(spark, sf), as_queries(spark, sf), K, CODED_PROBES, SURVIVORS))


@query(
    "vector_topk_coded_recall",
    f"""SELECT CAST(sum(least({K}, n)) AS BIGINT) AS expected, TRUE AS nine_tenths, {CODE_BYTES}::BIGINT AS code_bytes, 256::BIGINT AS vector_bytes
    FROM (SELECT (SELECT count(*) FROM embeddings) AS n FROM embeddings)""",
)
def vector_topk_coded_recall(spark, sf):
    """Whether the codes find nine tenths of the exact results, and what they read of a row instead of its vector."""
    stored, wanted = coded_vectors(spark, sf), as_queries(spark, sf)
    found = search_coded(stored, wanted, K, CODED_PROBES, SURVIVORS)
    share = ann.recall(found, se.search(vectors(spark, sf), wanted, K, id_col="vec_id"), "vec_id")
    size = stored.coded().agg(F.max(F.length("code"))).first()[0] or 0
    whole = stored.vectors().agg(F.max(F.size("embedding") * 4)).first()[0] or 0
    return share.select("expected", (F.col("recall") >= 0.9).alias("nine_tenths"), F.lit(size).cast("bigint").alias("code_bytes"), F.lit(whole).cast("bigint").alias("vector_bytes"))


def partitioned(spark, sf) -> tuple[PartitionedTable, DataFrame, DataFrame]:
    """(an empty table, chunks of labelled documents, all chunks)."""
    rows = text_chunks(spark, sf).select("chunk_id", "document_id", "content_hash", "lang")
    labels = table(spark, sf, "labels").select(F.format_string("doc_%d", "doc_id").alias("document_id"))
    return PartitionedTable(spark, scratch_path(spark, "partitioned"), rows.schema, 16), rows.join(labels, "document_id", "left_semi").select(*rows.columns), rows


@query("partitioned_add", "SELECT 'doc_' || doc_id || '_chunk_0000' AS chunk_id, sha256(text) AS content_hash FROM documents")
def partitioned_add(spark, sf):
    """The chunks of labelled documents, then all chunks with those twice, then all once more."""
    store, known, rows = partitioned(spark, sf)
    store.add(known)
    store.add(rows.unionByName(known))
    store.add(rows)
    return store.read().select("chunk_id", "content_hash")


@query(
    "partitioned_replace",
    """SELECT 'doc_' || doc_id || '_chunk_0000' AS chunk_id,
      CASE WHEN lang <> 'en' AND doc_id IN (SELECT doc_id FROM labels) THEN sha256(sha256(text)) ELSE sha256(text) END AS content_hash FROM documents""",
)
def partitioned_replace(spark, sf):
    """Labelled documents that are not English come again with other content, the other labelled ones as they were."""
    store, known, rows = partitioned(spark, sf)
    store.add(rows)
    other = F.when(F.col("lang") == "en", F.col("content_hash")).otherwise(F.sha2("content_hash", 256))
    store.add(known.withColumn("content_hash", other), "replace")
    store.compact(2)
    return store.read().select("chunk_id", "content_hash")


@query(
    "looked_up_chunks",
    """SELECT a.vec_id AS query_id, 'doc_' || d.doc_id || '_chunk_0000' AS chunk_id, sha256(d.text) AS text_hash
    FROM embeddings a JOIN documents d ON d.doc_id = a.vec_id % 1500""",
)
def looked_up_chunks(spark, sf):
    """Texts of the chunks that a table of candidates names, from a bucketed table of all chunks."""
    stored = lookup.write_bucketed(text_chunks(spark, sf).select("chunk_id", "text"), scratch_path(spark, "bucketed"))
    found = vectors(spark, sf).select(F.col("vec_id").alias("query_id"), F.format_string("doc_%d_chunk_0000", F.col("vec_id") % 1500).alias("chunk_id"))
    return lookup.looked_up(found, stored, ["text"]).select("query_id", "chunk_id", F.sha2("text", 256).alias("text_hash"))
