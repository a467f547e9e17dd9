"""Queries over ingest: cleaning, redaction, classification, normalised documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.functions import text as tx
from runlore.functions.html import html_to_text
from runlore.operators import chunking, language
from runlore.queries.base import CLEAN, LINES, REDACT, TYPE_SQL, WORDS, chunk_sql, query, table, texts, type_of_source
from runlore.session import spread
from runlore.sources import alerts, documents as docs, tickets, wiki

NOW = 1706659200  # 2024-01-31 00:00:00 UTC


def fixed_now():
    return F.timestamp_seconds(F.lit(NOW))


@query("clean_text", f"SELECT doc_id, {CLEAN.format('text')} AS cleaned, {LINES.format('text')} AS lines FROM documents")
def clean_text(spark, sf):
    t = F.col("text")
    return texts(spark, sf).select("doc_id", tx.clean_text(t).alias("cleaned"), tx.clean_text_keep_lines(t).alias("lines"))


@query("redact_sensitive", f"SELECT doc_id, {REDACT.format(CLEAN.format('text'))} AS redacted FROM documents")
def redact_sensitive(spark, sf):
    return texts(spark, sf).select("doc_id", tx.redact(tx.clean_text(F.col("text"))).alias("redacted"))


@query(
    "document_identity",
    f"""SELECT 'runbook_' || doc_id || '_' || substr(sha256(text), 1, 6) AS document_id, sha256(text) AS content_hash,
        len({WORDS.format('text')}) AS word_count FROM documents""",
)
def document_identity(spark, sf):
    t = F.col("text")
    return texts(spark, sf).select(
        F.concat(F.lit("runbook_"), "doc_id", F.lit("_"), tx.stable_suffix(t, 6)).alias("document_id"),
        tx.content_hash(t).alias("content_hash"),
        tx.word_count(t).alias("word_count"),
    )


@query(
    "classify_documents",
    """SELECT doc_id, CASE
         WHEN regexp_matches(p, 'post-mortem|postmortem|post_mortem|incident report|retrospective')
           OR regexp_matches(lower(text), 'post-mortem|postmortem|post_mortem|incident report|retrospective') THEN 'post_mortem'
         WHEN regexp_matches(p, 'runbook|playbook') THEN 'runbook' ELSE 'documentation' END AS document_type
       FROM (SELECT *, '/kb/' || CASE lang WHEN 'en' THEN 'runbooks' WHEN 'de' THEN 'post-mortems' WHEN 'fr' THEN 'playbook'
               ELSE 'wiki' END || '/' || doc_id || '.md' AS p FROM documents)""",
)
def classify_documents(spark, sf):
    folder = F.when(F.col("lang") == "en", "Runbooks").when(F.col("lang") == "de", "Post-Mortems")
    path = F.concat(F.lit("/kb/"), folder.when(F.col("lang") == "fr", "playbook").otherwise("wiki"), F.lit("/"), "doc_id", F.lit(".md"))
    return texts(spark, sf).select("doc_id", tx.classify(path, F.col("text")).alias("document_type"))


@query(
    "titles_and_headings",
    r"""SELECT doc_id, coalesce(nullif(trim(regexp_extract(md, '(?m)^#\s+(.+)$', 1)), ''), 'none') AS title,
          array_to_string(regexp_extract_all(md, '(?m)^#{1,3}\s+(.+)$', 1), '|') AS headings
        FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN '# ' ELSE '' END || replace(text, chr(10), chr(10) || '## ') AS md FROM documents)""",
)
def titles_and_headings(spark, sf):
    mark = F.when(F.col("lang") == "en", "# ").otherwise("")
    md = F.concat(mark, F.replace("text", F.lit("\n"), F.lit("\n## ")))
    return texts(spark, sf).select("doc_id", md.alias("md")).select(
        "doc_id",
        F.coalesce(tx.first_heading(F.col("md")), F.lit("none")).alias("title"),
        F.array_join(tx.headings(F.col("md")), "|").alias("headings"),
    )


def doc_rows(spark, sf, text=None) -> DataFrame:
    """The documents table as knowledge-base documents, cleaned and redacted."""
    text = text if text is not None else tx.redact(tx.clean_text(F.col("text")))
    return docs.conform(
        texts(spark, sf).select(
            F.concat(F.lit("doc_"), "doc_id").alias("document_id"),
            F.lit("local_files").alias("source_system"),
            type_of_source().alias("document_type"),
            F.concat(F.lit("Note "), "doc_id").alias("title"),
            text.alias("content_text"),
            F.col("source").alias("service"),
            F.when(F.col("lang") == "en", "production").otherwise(F.col("lang")).alias("environment"),
            F.col("lang").alias("language"),
        )
    )


PARAGRAPHS = "replace(text, chr(10), chr(10) || chr(10))"


def paragraphs():
    """Every line of the text as a paragraph of its own."""
    return F.replace("text", F.lit("\n"), F.lit("\n\n"))


def _chunk_columns(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "document_id", "chunk_index", "total_chunks", "token_count", "strategy", "text")


def _chunk_select(name: str, strategy: str) -> str:
    return f"""SELECT printf('%s_chunk_%04d', id, i) AS chunk_id, id AS document_id, i AS chunk_index,
        count(*) OVER (PARTITION BY id) AS total_chunks, len({WORDS.format('text')}) AS token_count, '{strategy}' AS strategy, text FROM {name}"""


DOC_SQL = f"src AS (SELECT 'doc_' || doc_id AS id, {REDACT.format(CLEAN.format('text'))} AS text, {TYPE_SQL} AS kind FROM documents)"
PARAGRAPH_SQL = f"src AS (SELECT 'doc_' || doc_id AS id, {PARAGRAPHS} AS text, {TYPE_SQL} AS kind FROM documents)"


@query("sliding_window_chunks", f"WITH {DOC_SQL},{chunk_sql('ch', 'src', 'sliding_window')} {_chunk_select('ch', 'sliding_window')}")
def sliding_window_chunks(spark, sf):
    return _chunk_columns(chunking.chunk_with(doc_rows(spark, sf), chunking.sliding_windows(), "sliding_window"))


@query("sentence_chunks", f"WITH RECURSIVE {DOC_SQL},{chunk_sql('ch', 'src', 'sentence', size=256)} {_chunk_select('ch', 'sentence')}")
def sentence_chunks(spark, sf):
    return _chunk_columns(chunking.chunk_with(doc_rows(spark, sf), chunking.grouped_sentences(), "sentence"))


@query("section_chunks", f"WITH RECURSIVE {PARAGRAPH_SQL},{chunk_sql('ch', 'src', 'section')} {_chunk_select('ch', 'section')}")
def section_chunks(spark, sf):
    rows = doc_rows(spark, sf, paragraphs())
    return _chunk_columns(chunking.chunk_with(rows, chunking.merged_sections(), "section"))


@query(
    "section_chunks_small",
    f"WITH RECURSIVE {PARAGRAPH_SQL},{chunk_sql('ch', 'src', 'section', size=64, low=10)} {_chunk_select('ch', 'section')}",
)
def section_chunks_small(spark, sf):
    rows = doc_rows(spark, sf, paragraphs())
    return _chunk_columns(chunking.chunk_with(rows, chunking.merged_sections(64, 10, 30), "section"))


_BY_TYPE = f"""WITH RECURSIVE {PARAGRAPH_SQL},
sec AS (SELECT * FROM src WHERE kind IN ('incident_ticket', 'post_mortem')), sen AS (SELECT * FROM src WHERE kind = 'alert'),
sli AS (SELECT * FROM src WHERE kind IN ('runbook', 'documentation', 'unknown')),
{chunk_sql('c1', 'sec', 'section')}, {chunk_sql('c2', 'sen', 'sentence', size=256)}, {chunk_sql('c3', 'sli', 'sliding_window')}"""


@query(
    "chunks_by_type",
    f"{_BY_TYPE} {_chunk_select('c1', 'section')} UNION ALL {_chunk_select('c2', 'sentence')} UNION ALL {_chunk_select('c3', 'sliding_window')}",
)
def chunks_by_type(spark, sf):
    return _chunk_columns(chunking.chunk_documents(doc_rows(spark, sf, paragraphs())))


@query(
    "chunk_counts",
    f"""{_BY_TYPE}, n AS (SELECT id, count(*) AS n FROM (SELECT id FROM c1 UNION ALL SELECT id FROM c2 UNION ALL SELECT id FROM c3) GROUP BY id)
    SELECT kind AS document_type, count(*) AS documents, CAST(sum(coalesce(n, 0)) AS BIGINT) AS chunks,
      CAST(count(*) FILTER (WHERE n IS NULL) AS BIGINT) AS documents_without_chunks FROM src LEFT JOIN n USING (id) GROUP BY kind""",
)
def chunk_counts(spark, sf):
    rows = doc_rows(spark, sf, paragraphs())
    return chunking.chunk_counts(rows, chunking.chunk_documents(rows))


def ticket_rows(spark, sf) -> DataFrame:
    """Tickets made of documents and their labels."""
    labels = table(spark, sf, "labels")
    rows = texts(spark, sf).join(labels, "doc_id", "left")
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    return rows.select(
        F.col("doc_id").cast("string").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("description"),
        F.lit(None).cast("string").alias("error_message"),
        F.when(F.col("toxic") == 1, "").otherwise(F.col("lang")).alias("resolution_notes"),
        F.when(F.col("quality") == 1, F.col("lang")).alias("root_cause"),
        F.when(F.col("quality") == 1, "P2").when(F.col("quality") == 0, "P1").alias("priority"),
        F.col("source").alias("service"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("environment"),
        F.concat(F.lit("2024-01-"), day, F.lit("T10:30:00Z")).alias("created_at"),
        F.when(F.col("quality") == 1, F.concat(F.lit("2024-02-"), day, F.lit("T11:45:00+01:00"))).otherwise("").alias("resolved_at"),
        F.array("lang", "source").alias("tags"),
    )


TICKET_SQL = """tk AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, text AS description,
    CASE WHEN toxic = 1 THEN '' ELSE lang END AS resolution_notes, CASE WHEN quality = 1 THEN lang END AS root_cause,
    CASE quality WHEN 1 THEN 'P2' WHEN 0 THEN 'P1' END AS priority, source AS service, quality, lang, source,
    lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') AS day FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _ticket_select(clean: str) -> str:
    return f"""SELECT 'ticket_' || id AS document_id, title, {REDACT.format(clean.format('''concat_ws(chr(10) || chr(10),
        CASE WHEN title <> '' THEN 'Incident: ' || title END, CASE WHEN priority <> '' THEN 'Priority: ' || priority END,
        CASE WHEN service <> '' THEN 'Affected Service: ' || service END,
        CASE WHEN description <> '' THEN 'Description:' || chr(10) || description END,
        CASE WHEN resolution_notes <> '' THEN 'Resolution:' || chr(10) || resolution_notes END,
        CASE WHEN root_cause <> '' THEN 'Root Cause: ' || root_cause END)'''))} AS content_text,
      epoch_us(CAST('2024-01-' || day || ' 10:30:00' AS TIMESTAMP)) AS created_us,
      CASE WHEN quality = 1 THEN epoch_us(CAST('2024-02-' || day || ' 10:45:00' AS TIMESTAMP))
        ELSE epoch_us(CAST('2024-01-' || day || ' 10:30:00' AS TIMESTAMP)) END AS modified_us,
      coalesce(priority, 'unknown') AS priority, service, 'unknown' AS status, 'production' AS environment,
      lang || ',' || source AS tags, coalesce(root_cause, '') AS root_cause FROM tk"""


def _document_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "document_id", "title", "content_text", F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("last_modified").alias("modified_us"), "priority", "service", "status", "environment",
        F.array_join("tags", ",").alias("tags"), F.col("metadata")["root_cause"].alias("root_cause"),
    )


@query("ticket_documents", f"WITH {TICKET_SQL} {_ticket_select(LINES)}")
def ticket_documents(spark, sf):
    return _document_columns(tickets.ticket_documents(ticket_rows(spark, sf), now=fixed_now()))


@query("ticket_documents_strict", f"WITH {TICKET_SQL} {_ticket_select(CLEAN)}")
def ticket_documents_strict(spark, sf):
    return _document_columns(tickets.ticket_documents(ticket_rows(spark, sf), strict=True, now=fixed_now()))


@query(
    "remote_ticket_documents",
    f"""SELECT 'snow_' || d.doc_id AS document_id, 'INC' || d.doc_id AS number, {REDACT.format(CLEAN.format('''
        concat_ws(chr(10) || chr(10), 'Incident: ' || split_part(text, chr(10), 1), 'Category: ' || source, 'Priority: ' || lang,
        'Service: ' || source, 'Description:' || chr(10) || text, 'Resolution:' || chr(10), 'Root Cause: ')'''))} AS content_text,
        epoch_us(CAST('2024-01-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') || ' 10:30:00' AS TIMESTAMP)) AS created_us
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
      WHERE quality = 1 AND CAST('2024-01-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') || ' 10:30:00' AS TIMESTAMP) > TIMESTAMP '2024-01-11 00:00:00'""",
)
def remote_ticket_documents(spark, sf):
    rows = texts(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    created = F.concat(F.lit("2024-01-"), day, F.lit(" 10:30:00"))
    none = F.lit(None).cast("string")
    records = rows.select(
        F.col("doc_id").cast("string").alias("sys_id"),
        F.concat(F.lit("INC"), "doc_id").alias("number"),
        F.substring_index("text", "\n", 1).alias("short_description"),
        F.col("text").alias("description"),
        none.alias("close_notes"),
        F.col("source").alias("category"),
        F.col("source").alias("u_service_name"),
        none.alias("u_root_cause"),
        created.alias("sys_created_on"),
        created.alias("sys_updated_on"),
        F.struct(F.col("lang").alias("display_value")).alias("priority"),
        F.when(F.col("quality").isNotNull(), F.struct(
            F.lit("Resolved").alias("display_value"), F.when(F.col("quality") == 1, "6").otherwise("2").alias("value"))).alias("state"),
    )
    found = tickets.remote_ticket_documents(tickets.resolved_since(records, 20, fixed_now()), strict=True)
    return found.select("document_id", F.col("metadata")["number"].alias("number"), "content_text", F.unix_micros("created_at").alias("created_us"))


_PAGE_TEXT = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"""
_PAGE_TEXT = rf"""regexp_replace({_PAGE_TEXT}, '<[^>]+>', ' ', 'g')"""
for _entity, _char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
    _PAGE_TEXT = f"replace({_PAGE_TEXT}, '&{_entity};', '{_char}')"
_PAGE_TEXT = rf"regexp_replace({_PAGE_TEXT}, '&amp$', '&')"


@query(
    "wiki_documents",
    rf"""SELECT 'confluence_' || page_id AS document_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
        regexp_extract(url, '^https?://([^/?#]+)', 1) AS space_key, {REDACT.format(CLEAN.format(_PAGE_TEXT))} AS content_text FROM pages""",
)
def wiki_documents(spark, sf):
    pages = spread(table(spark, sf, "pages"), "page_id")
    rows = wiki.html_documents(pages, strict=True)
    return rows.select("document_id", "title", F.col("metadata")["space_key"].alias("space_key"), "content_text")


_NODES = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', '<>', 'g'), '(?s)<!--.*?-->', '<>', 'g'), '<[^>]*>', chr(1), 'g')"""
for _entity, _char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
    _NODES = f"replace({_NODES}, '&{_entity};', '{_char}')"
_NODES = rf"regexp_replace({_NODES}, '&amp(\x01|$)', '&\1')"


@query(
    "page_text",
    rf"""SELECT page_id, array_to_string(list_filter(list_transform(string_split({_NODES}, chr(1)),
      lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: t <> ''), chr(10)) AS text FROM pages""",
)
def page_text(spark, sf):
    pages = spread(table(spark, sf, "pages"), "page_id")
    return pages.select("page_id", html_to_text(F.col("html")).alias("text"))


_ALERT = """printf('Alert %s fired. User %d affected. Value %.2f measured. Properties %s', event_type, user_id, value, props)"""


@query(
    "alert_documents",
    f"""SELECT 'alert_' || event_id AS document_id, 'alert' AS document_type, {REDACT.format(CLEAN.format(_ALERT))} AS content_text,
        len({WORDS.format(_ALERT)}) AS word_count FROM events WHERE event_type = 'error'""",
)
def alert_documents(spark, sf):
    return alerts.alert_documents(table(spark, sf, "events")).select("document_id", "document_type", "content_text", "word_count")


def all_sources(spark, sf) -> DataFrame:
    return docs.union_sources(
        doc_rows(spark, sf),
        tickets.ticket_documents(ticket_rows(spark, sf), now=fixed_now()),
        wiki.html_documents(spread(table(spark, sf, "pages"), "page_id"), now=fixed_now()),
        alerts.alert_documents(table(spark, sf, "events")),
    )


@query(
    "document_union",
    f"""SELECT source_system, document_type, count(*) AS documents FROM (
        SELECT 'local_files' AS source_system, {TYPE_SQL} AS document_type FROM documents
        UNION ALL SELECT 'ticket_system', 'incident_ticket' FROM documents
        UNION ALL SELECT 'confluence', 'documentation' FROM pages
        UNION ALL SELECT 'alerts', 'alert' FROM events WHERE event_type = 'error') GROUP BY ALL""",
)
def document_union(spark, sf):
    return all_sources(spark, sf).groupBy("source_system", "document_type").agg(F.count("*").alias("documents"))


@query(
    "ingest_counts",
    "SELECT 'tickets' AS source_system, count(*) FILTER (WHERE priority IS NOT NULL) AS ingested, "
    "count(*) FILTER (WHERE priority IS NULL) AS errors FROM (SELECT CASE quality WHEN 1 THEN 'P2' WHEN 0 THEN 'P1' END AS priority "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
)
def ingest_counts(spark, sf):
    rows = ticket_rows(spark, sf).withColumn("source_system", F.lit("tickets"))
    return docs.ingest_counts(rows.where(F.col("priority").isNotNull()), rows.where(F.col("priority").isNull()))


@query(
    "document_round_trip",
    f"""WITH {DOC_SQL} SELECT id AS document_id, kind AS document_type, text AS content_text, sha256(text) AS content_hash,
        len({WORDS.format('text')}) AS word_count FROM src""",
)
def document_round_trip(spark, sf):
    back = docs.from_json(docs.to_json(doc_rows(spark, sf)))
    return back.select("document_id", "document_type", "content_text", "content_hash", "word_count")


_LANGUAGE = rf"""WITH f AS (SELECT doc_id, lang, ' ' || lower({CLEAN.format('text')}) || ' ' AS f FROM documents),
g AS (SELECT doc_id, lang, unnest(list_transform(generate_series(1, greatest(0, length(f) - 2)),
    lambda i: (unicode(substr(f, i, 1)) * 961 + unicode(substr(f, i + 1, 1)) * 31 + unicode(substr(f, i + 2, 1))) % 16384)) AS gram FROM f),
h AS (SELECT doc_id, lang, gram, count(*) AS times FROM g GROUP BY ALL),
c AS (SELECT lang, gram, sum(times) AS n FROM h WHERE doc_id % 5 <> 0 GROUP BY lang, gram),
t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
s AS (SELECT h.doc_id, t.lang, round(sum(times * ln((coalesce(c.n, 0) + 1) / (total + 16384))), 6) AS score
  FROM h CROSS JOIN t LEFT JOIN c ON c.lang = t.lang AND c.gram = h.gram GROUP BY h.doc_id, t.lang),
best AS (SELECT doc_id, lang AS language FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC) AS r FROM s) WHERE r = 1)"""


def _detected(spark, sf):
    """Languages of all documents, learned from four fifths of them."""
    rows = texts(spark, sf).select("doc_id", "text", "lang", (F.col("doc_id") % 5 == 0).alias("held_out"))
    return rows, language.detect_languages(rows, language.language_profiles(rows.where("NOT held_out")), "doc_id")


@query("language_detection", f"{_LANGUAGE} SELECT d.doc_id, coalesce(language, 'en') AS language FROM documents d LEFT JOIN best USING (doc_id)")
def language_detection(spark, sf):
    return _detected(spark, sf)[1]


@query(
    "language_agreement",
    f"""{_LANGUAGE} SELECT lang, doc_id % 5 = 0 AS held_out, count(*) AS texts, count(*) FILTER (WHERE lang = coalesce(language, 'en')) AS agree
    FROM documents LEFT JOIN best USING (doc_id) GROUP BY ALL""",
)
def language_agreement(spark, sf):
    rows, found = _detected(spark, sf)
    return language.agreement(found, rows, "doc_id", "held_out")
