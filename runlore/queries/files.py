"""Queries that write given tables as files of the kinds the sources read, and read them back through the sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.queries.base import LINES, query, table
from runlore.queries.diagnosis import INCIDENT_SQL, incidents
from runlore.queries.documents import TICKET_SQL, _ticket_select, ticket_rows
from runlore.session import scratch_path
from runlore.sources import documents as docs
from runlore.sources.base import TextFiles, TicketFiles, ingest
from runlore.sources.incidents import read_eval_samples, read_incidents, validate_incidents, write_results
from runlore.sources.records import read_records
from runlore.streaming.jobs import write_chunks


#: Characters of a file of tickets, about; a row is never cut.
ARRAY_CHARS = 4 << 20


def write_arrays(rows: DataFrame, path: str) -> None:
    """JSON files with one array each, of up to about ``ARRAY_CHARS``. Few rows are strings in a task at a time."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for at in range(0, batch.num_rows, 64):
                for value in batch.column(0).slice(at, 64).to_pylist():
                    held.append(value)
                    size += len(value)
                    if size >= ARRAY_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(held) + "]"])], names=["value"])
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(held) + "]"])], names=["value"])

    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInArrow(joined, "value string")
    lines.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").format("text").save(f"{path}-parts")
    # Text writers name their files .txt; the sources go by the name, so each is given the one it is read by.
    rename(rows, f"{path}-parts", path, ".json")


def rename(df: DataFrame, source: str, target: str, ending: str) -> None:
    """Move the written files of a folder into another one under another ending."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(target))
    for status in fs.listStatus(path(source)):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), path(f"{target}/{name.rsplit('.', 1)[0]}{ending}"))


def broken() -> Column:
    return F.col("id").cast("bigint") % 50 == 7


def ticket_folder(spark, sf) -> str:
    """Tickets of English documents as arrays, German ones as lines, of which some are cut off, the others as CSV."""
    rows = ticket_rows(spark, sf)
    kind = F.element_at("tags", 1)
    root = scratch_path(spark, "tickets")
    write_arrays(rows.where(kind == "en"), root)
    line = F.to_json(F.struct(*rows.columns))
    lines = rows.where(kind == "de").select(F.when(broken(), F.substring(line, 1, 20)).otherwise(line).alias("value"))
    lines.write.text(f"{root}-lines")
    rename(rows, f"{root}-lines", root, ".jsonl")
    cells = rows.where(~kind.isin("en", "de")).withColumn("tags", F.array_join("tags", ","))
    cells.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{root}-cells")
    rename(rows, f"{root}-cells", root, ".csv")
    return root


_READ = f"""read AS (SELECT t.* FROM ({_ticket_select(LINES)}) t JOIN documents d ON t.document_id = 'ticket_' || d.doc_id
  WHERE NOT (d.lang = 'de' AND d.doc_id % 50 = 7))"""


@query("ticket_files", f"WITH {TICKET_SQL}, {_READ} SELECT document_id, title, content_text, priority, service, root_cause FROM read")
def ticket_files(spark, sf):
    good, _ = TicketFiles(ticket_folder(spark, sf)).read(spark)
    return good.select("document_id", "title", "content_text", "priority", "service", F.col("metadata")["root_cause"].alias("root_cause"))


@query(
    "ticket_file_counts",
    """SELECT 'ticket_system' AS source_system, count(*) FILTER (WHERE NOT bad) AS ingested, count(*) FILTER (WHERE bad) AS errors
    FROM (SELECT lang = 'de' AND doc_id % 50 = 7 AS bad FROM documents)""",
)
def ticket_file_counts(spark, sf):
    return docs.ingest_counts(*TicketFiles(ticket_folder(spark, sf)).read(spark))


@query(
    "ingest_run",
    """SELECT 'ticket_system' AS source_system, count(*) FILTER (WHERE NOT bad) AS ingested, count(*) FILTER (WHERE bad) AS errors, 1::BIGINT AS warnings
    FROM (SELECT lang = 'de' AND doc_id % 50 = 7 AS bad FROM documents)
    UNION ALL SELECT 'local_files', count(*), 0, 1 FROM benchmark""",
)
def ingest_run(spark, sf):
    """Two sources that are there and one that isn't: rows and errors of each, and a warning."""
    root = scratch_path(spark, "texts")
    table(spark, sf, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(root)
    run = ingest(spark, [TicketFiles(ticket_folder(spark, sf)), TextFiles(f"{root}-missing"), TextFiles(root)])
    return run.counts.withColumn("warnings", F.lit(len(run.warnings)).cast("bigint"))


@query(
    "text_files",
    f"""SELECT item_id, {LINES.format("text || chr(10)")} AS content_text, 'documentation' AS document_type, 'en' AS language FROM benchmark""",
)
def text_files(spark, sf):
    """Each benchmark passage as a text file in a folder of its own."""
    root = scratch_path(spark, "texts")
    table(spark, sf, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(root)
    read, _ = TextFiles(root).read(spark)
    item = F.regexp_extract(F.col("metadata")["file_path"], "item_id=([0-9]+)", 1).cast("bigint")
    return read.select(item.alias("item_id"), "content_text", "document_type", "language")


@query(
    "incident_files",
    f"""WITH {INCIDENT_SQL} SELECT incident_id, title, description, service, priority, error_message,
      array_to_string(comps, ',') AS components FROM inc WHERE title <> ''""",
)
def incident_files(spark, sf):
    """Incidents as JSON arrays, read, validated, written as results and read again."""
    rows = incidents(spark, sf)
    root = scratch_path(spark, "incidents")
    write_arrays(rows.withColumn("title", F.nullif("title", F.lit(""))), root)
    valid, _ = validate_incidents(read_incidents(spark, root))
    out = scratch_path(spark, "results")
    write_results(valid, out)
    back = spark.read.schema(valid.schema).json(out)
    return back.select(
        "incident_id", "title", "description", "service", "priority", "error_message", F.array_join("affected_components", ",").alias("components"))


@query(
    "eval_sample_files",
    """SELECT conv_id || '-' || turn AS incident_id, text AS description, CASE WHEN turn > 0 THEN 'src' || conv_id % 20 ELSE '' END AS service,
      CASE WHEN turn > 0 THEN role ELSE 'P3' END AS priority, '' AS error_message FROM conversations""",
)
def eval_sample_files(spark, sf):
    """Turns as labelled samples; a first turn lacks the keys that have defaults."""
    turns = table(spark, sf, "conversations")
    rows = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("incident_id"), F.substring_index("text", ".", 1).alias("title"), F.col("text").alias("description"),
        F.when(F.col("turn") > 0, F.concat(F.lit("src"), F.col("conv_id") % 20)).alias("service"),
        F.when(F.col("turn") > 0, F.col("role")).alias("priority"), F.lit("x").alias("ground_truth_root_cause"))
    root = scratch_path(spark, "samples")
    write_arrays(rows, root)
    return read_eval_samples(spark, root).select("incident_id", "description", "service", "priority", "error_message")


RECORD = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "lang", "source")], T.StructField("n_chars", T.LongType())])
_RECORDS = "SELECT doc_id, sha256(text) AS text_hash, lang, source, n_chars FROM documents"


def _shown(rows):
    return rows.select("doc_id", F.sha2("text", 256).alias("text_hash"), "lang", "source", "n_chars")


@query("landed_records", _RECORDS)
def landed_records(spark, sf):
    """The documents landed as lines of records, read by ranges of 256 KB."""
    root = scratch_path(spark, "landed")
    table(spark, sf, "documents").select(RECORD.names).write.json(root)
    return _shown(read_records(spark, root, RECORD, pathGlobFilter="*.json", split_bytes=256 << 10)[0])


@query("landed_records_stream", _RECORDS)
def landed_records_stream(spark, sf):
    """Two landings, the English documents and then the others, followed by a stream that goes on where it stopped."""
    root, out, state = (scratch_path(spark, n) for n in ("landed", "landed-out", "landed-state"))
    rows = table(spark, sf, "documents").select(RECORD.names)
    english = F.col("lang").eqNullSafe("en")
    for some in (rows.where(english), rows.where(~english)):
        some.write.mode("append").json(root)
        good, _ = read_records(spark, root, RECORD, stream=True, pathGlobFilter="*.json", split_bytes=256 << 10)
        write_chunks(good, out, state).awaitTermination()
    return _shown(spark.read.parquet(out))
