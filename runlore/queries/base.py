"""Registry of queries, the test tables, and the views that queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.session import ship_package, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; 32-bit integers come out as 64-bit ones, as SQL counts do."""

    def register(run: Query) -> Query:
        def widened(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            df = run(spark, sf_dir)
            return df.select(
                *[
                    F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, T.IntegerType) else F.col(f"`{f.name}`")
                    for f in df.schema.fields
                ]
            )

        QUERIES[name] = widened
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, over all cores when it is small."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


# Type of a test document by its source: (first number, type), up to the next.
TYPE_BY_SOURCE = (
    (0, "incident_ticket"), (5, "runbook"), (9, "post_mortem"), (13, "documentation"), (16, "alert"), (18, "unknown"),
)


def type_of_source() -> Column:
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    out = F.lit("unknown")
    for first, name in TYPE_BY_SOURCE:
        out = F.when(number >= first, name).otherwise(out)
    return out


TYPE_SQL = "CASE " + " ".join(
    f"WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) >= {first} THEN '{name}'"
    for first, name in reversed(TYPE_BY_SOURCE)
) + " ELSE 'unknown' END"

# Building blocks of the SQL side. The patterns of what is redacted, as in ``functions/text.py``.
CLEAN = r"trim(replace(regexp_replace({0}, '\s+', ' ', 'g'), chr(0), ''))"
LINES = r"regexp_replace(replace(regexp_replace({0}, '[ \t]+', ' ', 'g'), chr(0), ''), '^\s+|\s+$', '', 'g')"
REDACT = (
    r"regexp_replace(regexp_replace(regexp_replace({0}, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b', '[REDACTED_IP_ADDRESS]', 'g'), "
    r"'(?i)(api[_-]?key|token|secret|password)\s*[=:]\s*\S+', '[REDACTED_API_KEY]', 'g'), "
    r"'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b', '[REDACTED_EMAIL]', 'g')"
)
TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"


def chunk_sql(name: str, source: str, strategy: str, size: int = 512, overlap: int = 50, low: int = 50) -> str:
    """CTEs ending in ``name(id, i, text)``: the chunks of the texts of ``source(id, text)``."""
    n = name
    if strategy == "sliding_window":
        return f"""
{n}_w AS (SELECT id, {WORDS.format('text')} AS w FROM {source}),
{n} AS (SELECT id, CAST(i AS BIGINT) AS i, array_to_string(w[i*{size - overlap}+1 : i*{size - overlap}+{size}], ' ') AS text
  FROM (SELECT id, w, unnest(generate_series(0, greatest(0, CAST(ceil((len(w) - {size}) / {size - overlap}.0) AS BIGINT)))) AS i
        FROM {n}_w WHERE len(w) > 0))"""
    if strategy == "sentence":
        pieces = r"regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
        glue, large = " ", "FALSE"
    else:
        pieces = r"regexp_split_to_array(text, '\n{2,}')"
        glue, large = "\\n\\n", f"p.c > {size}"
    glue = f"E'{glue}'" if "\\" in glue else f"'{glue}'"
    cut = "" if strategy == "sentence" else f"""
  UNION ALL
  SELECT id, first, i, array_to_string(w[i*{size - 30}+1 : i*{size - 30}+{size}], ' ') FROM (
    SELECT id, first, w, unnest(generate_series(0, greatest(0, CAST(ceil((len(w) - {size}) / {size - 30}.0) AS BIGINT)))) AS i
    FROM (SELECT r.id, r.k AS first, {WORDS.format('p.piece')} AS w FROM {n}_r r JOIN {n}_p p ON p.id = r.id AND p.k = r.k WHERE r.large))"""
    last = f"""
{n} AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY first, sub) - 1 AS i, text FROM {n}_t)""" if strategy == "sentence" else f"""
{n}_c AS (SELECT id, first, sub, text, len({WORDS.format('text')}) AS c FROM {n}_t),
{n}_d AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY id ORDER BY first, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {n}_c),
{n}_e AS (SELECT *, count(*) FILTER (WHERE before = 0 OR (c >= {low} AND before >= {low})) OVER (PARTITION BY id ORDER BY first, sub) AS part FROM {n}_d),
{n} AS (SELECT id, part - 1 AS i, string_agg(text, E'\\n\\n' ORDER BY first, sub) AS text FROM {n}_e GROUP BY id, part)"""
    return f"""
{n}_a AS (SELECT id, list_filter(list_transform({pieces}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS a FROM {source}),
{n}_p AS (SELECT id, k, piece, len({WORDS.format('piece')}) AS c FROM (SELECT id, unnest(a) AS piece, generate_subscripts(a, 1) AS k FROM {n}_a)),
{n}_r AS (
  SELECT p.id, p.k, p.k AS run, p.c AS total, {large} AS large FROM {n}_p p WHERE p.k = 1
  UNION ALL
  SELECT p.id, p.k,
    CASE WHEN NOT r.large AND NOT ({large}) AND r.total + p.c <= {size} THEN r.run ELSE p.k END,
    CASE WHEN NOT r.large AND NOT ({large}) AND r.total + p.c <= {size} THEN r.total + p.c ELSE p.c END,
    {large}
  FROM {n}_r r JOIN {n}_p p ON p.id = r.id AND p.k = r.k + 1),
{n}_t AS (
  SELECT r.id, r.run AS first, 0 AS sub, string_agg(p.piece, {glue} ORDER BY p.k) AS text
  FROM {n}_r r JOIN {n}_p p ON p.id = r.id AND p.k = r.k WHERE NOT r.large GROUP BY r.id, r.run{cut}),{last}"""


def bm25_sql(p: str, corpus: str, queries: str, k: int) -> str:
    """CTEs ending in ``{p}_top(query_id, id, s, rn)`` from ``corpus(id, text)`` and ``queries(query_id, text)``."""
    return f"""
{p}_tok AS (SELECT id, unnest({TERMS.format('text')}) AS t FROM {corpus}),
{p}_tf AS (SELECT id, t, count(*) AS tf FROM {p}_tok GROUP BY ALL),
{p}_len AS (SELECT id, len({TERMS.format('text')}) AS l FROM {corpus}),
{p}_st AS (SELECT count(*) AS n, avg(l) AS a FROM {p}_len),
{p}_df AS (SELECT t, count(*) AS df FROM {p}_tf GROUP BY t),
{p}_qt AS (SELECT query_id, t, count(*) AS qtf FROM (SELECT query_id, unnest({TERMS.format('text')}) AS t FROM {queries}) GROUP BY ALL),
{p}_qw AS (SELECT query_id, t, qtf, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf
  FROM {p}_qt LEFT JOIN {p}_df USING (t), {p}_st),
{p}_s AS (SELECT query_id, id, round(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 9) AS s
  FROM {p}_qw JOIN {p}_tf USING (t) JOIN {p}_len USING (id), {p}_st GROUP BY query_id, id),
{p}_top AS (SELECT * FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rn FROM {p}_s) WHERE rn <= {k})"""


def rerank_sql(name: str, candidates: str, p: str) -> str:
    """CTE ``name(query_id, id, score)``: term coverage of the candidates, statistics from the BM25 CTEs ``p``."""
    return f"""
{name} AS (SELECT query_id, id, 1 / (1 + exp(-(10 * (coalesce(got / nullif(total, 0), 0) - 0.5)))) AS score FROM (
  SELECT c.query_id, c.id, sum(w.idf) AS total, coalesce(sum(w.idf) FILTER (WHERE f.t IS NOT NULL), 0) AS got
  FROM {candidates} c LEFT JOIN {p}_qw w ON w.query_id = c.query_id LEFT JOIN {p}_tf f ON f.id = c.id AND f.t = w.t
  GROUP BY c.query_id, c.id))"""


def cosine_sql(k: int, where: str = "TRUE", score: str = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])") -> str:
    """CTE ``found(query_id, vec_id, lb, s, rank)``: exact top k of every vector against all that satisfy ``where``."""
    return f"""
scored AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, a.label AS la, b.label AS lb, {score} AS s
  FROM embeddings a, embeddings b WHERE {where}),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM scored)
  WHERE rank <= {k})"""
