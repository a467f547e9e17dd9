"""Registered queries of the corpus operators, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.llm.common import documents
from runlore.llm.filter_audit import audit_documents
from runlore.llm.fingerprints import fingerprint_documents
from runlore.llm.html_text import extract_pages
from runlore.llm.languages import fold, identify_documents
from runlore.llm.mixing import mix_documents
from runlore.llm.neighbours import near_duplicates
from runlore.llm.ngram_join import ngram_components
from runlore.llm.packing import pack_documents
from runlore.llm.quality import score_documents
from runlore.llm.sharding import ranked_documents, shard_rows
from runlore.llm.token_alignment import align_documents
from runlore.llm.token_files import read_tokens, write_tokens
from runlore.llm.urls import judge_urls, page_links
from runlore.session import scratch_path, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return run(spark, sf_dir)

        QUERIES[name] = shipped
        if sql is not None:
            SQL[name] = sql
        return run

    return register


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 1 THEN 5.0 WHEN 2 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 2 * source_size AS cap,
  sum(source_size) OVER ()::DOUBLE * 1.5 AS budget FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER o, 0)::DOUBLE AS held, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest
  FROM w WINDOW o AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, w * (budget - held) / rest > cap AS tried FROM r),
g AS (SELECT *, coalesce(min(CASE WHEN NOT tried THEN cap / w END) OVER (), 1e300) AS cut,
  coalesce(first_value(CASE WHEN tried THEN NULL ELSE held END IGNORE NULLS) OVER q, 0) AS h,
  coalesce(first_value(CASE WHEN tried THEN NULL ELSE rest END IGNORE NULLS) OVER q, 1) AS v
  FROM f WINDOW q AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
t AS (SELECT source, source_size, CASE WHEN tried THEN cap::DOUBLE ELSE w * (budget - h) / v END AS target FROM g),
b AS (SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS f FROM t),
c AS (SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.f, b.target - b.f * b.source_size AS budget,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u RANGE UNBOUNDED PRECEDING) AS after,
  sum(d.size) OVER (PARTITION BY d.source, d.u) AS same
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  size * (f + CASE WHEN budget < source_size AND 2 * after - same <= 2 * budget THEN 1 ELSE 0 END) AS taken FROM c"""


@query("op5_mixing", MIX_SQL)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    sized = documents(spark, sf_dir).select(
        "doc_id", "lang", "source", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = shard_rows(*ranked_documents(sized), 40, ["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint_documents(documents(spark, sf_dir))
    return rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint", "near_edited", "near_next")


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
_FORM = r"""CASE WHEN {host} <> '' THEN regexp_replace({host}, ':(80|443)\z', '') || regexp_replace({path}, '/(index\.html?)?\z', '') || '?' ||
  array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract({rest}, '\A[^?#]*\?([^#]*)', 1), ''), '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|\z)'))), '&') END"""
_REST = "CASE WHEN position('://' IN {u}) > 0 THEN substr({u}, position('://' IN {u}) + 3) END"
_HOST = r"coalesce(translate(regexp_extract({rest}, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = r"coalesce(regexp_extract({rest}, '\A[^/?#]*([^?#]*)', 1), '')"
_LINK = """CASE WHEN {t} LIKE '%://%' THEN {t} WHEN {t} LIKE '//%' THEN 'http:' || {t} WHEN {t} LIKE '/%' THEN 'http://' || host || {t} END"""
URL_SQL = rf"""
WITH RECURSIVE a AS (SELECT page_id, url, html, {_REST.format(u='url')} AS rest FROM pages),
b AS (SELECT *, {_HOST.format(rest='rest')} AS host, {_PATH.format(rest='rest')} AS path FROM a),
c AS (SELECT *, {_FORM.format(host='host', path='path', rest='rest')} AS node FROM b),
rules(rh, rp, v) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
m AS (SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, v) AS i
  FROM c JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)),
d AS (SELECT c.*, m.rule, m.v FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.i = 1),
raw AS (SELECT node, host, unnest([
  regexp_extract(regexp_extract(html, '(?is)<link\b([^>]*\brel\s*=\s*["'']?canonical\b[^>]*)>', 1), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
  regexp_extract(regexp_extract(html, '(?is)<meta\b([^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*)>', 1), '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)]) AS t FROM c),
t1 AS (SELECT node, {_LINK.format(t='t')} AS u FROM raw),
t2 AS (SELECT node, {_REST.format(u='u')} AS rest FROM t1 WHERE u IS NOT NULL),
t3 AS (SELECT node, rest, {_HOST.format(rest='rest')} AS host, {_PATH.format(rest='rest')} AS path FROM t2),
e AS (SELECT node AS x, {_FORM.format(host='host', path='path', rest='rest')} AS y FROM t3 WHERE node IS NOT NULL),
ee AS (SELECT x, y FROM e WHERE y IS NOT NULL UNION SELECT y, x FROM e WHERE y IS NOT NULL),
reach(x, y) AS (SELECT node, node FROM c WHERE node IS NOT NULL UNION SELECT r.x, ee.y FROM reach r JOIN ee ON ee.x = r.y),
k AS (SELECT r.x, max(CASE d.v WHEN 'allow' THEN 2 WHEN 'block' THEN 1 END) AS best FROM reach r JOIN d ON d.node = r.y GROUP BY r.x)
SELECT page_id, host, path, rule, coalesce(v, CASE k.best WHEN 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM d LEFT JOIN k ON k.x = d.node"""


@query("op2_url_filters", URL_SQL)
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules, page_links(pages))


@query("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = score_documents(documents(spark, sf_dir).select("doc_id", "text"), labels, fold("doc_id", 5) == 0)
    return rows.select("doc_id", "held_out", "score", "predicted")


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identify_documents(documents(spark, sf_dir).select("doc_id", "text", "lang"), fold("doc_id", 4) == 2)
    return rows.select("doc_id", "held_out", "lang_pred", "score")


NGRAM_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.x = w.doc_id"""


@query("op6_ngram_jaccard_join", NGRAM_SQL)
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


NEAR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id"""


@query("op1_embedding_near_dedup", NEAR_SQL)
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept")


@query("op11_token_files")
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    files = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "tokens"))
    return read_tokens(files, docs.schema["doc_id"].dataType)


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align_documents(documents(spark, sf_dir), *paths)


AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY x) AS least FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
  (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
  + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x))::INT + 8 * regexp_matches(x, '[#$%&*|]')::INT
  + 16 * coalesce(w.doc_id > least, false)::INT AS mask FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
b(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM b p, b q, b r, b s, b t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, t.bit])) = 5),
k AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, (VALUES (1), (2), (3), (4), (5)) v(step)),
g AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM c, k GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM g"""


@query("op13_filter_interaction_audit", AUDIT_SQL)
def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
