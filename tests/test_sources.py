import json

import pytest
from pyspark.sql import functions as F

from runlore import schemas
from runlore.sources import alerts, documents as docs, files, incidents as inc, tickets, wiki

NOW = 1_700_000_000


def now():
    return F.timestamp_seconds(F.lit(NOW))


@pytest.fixture
def ticket_folder(tmp_path):
    folder = tmp_path / "tickets"
    folder.mkdir()
    full = {
        "id": "T-1", "title": "Pool  exhausted", "description": "No\nconnections from 10.1.2.3", "error_message": "timeout",
        "resolution_notes": "Raised the size", "priority": "P1", "service": "payments", "status": "resolved",
        "root_cause": "slow query", "environment": "staging", "tags": ["db", "pool"],
        "created_at": "2024-01-15T10:30:00Z", "resolved_at": "2024-01-15T11:45:00Z",
    }
    (folder / "a.json").write_text(json.dumps([full, {"description": "only text", "created_at": "bad"}]))
    (folder / "b.csv").write_text('id,title,tags,priority\nT-3,"Disk, full","x,y",\n')
    (folder / "broken.json").write_text('[{"id": "T-9", ')
    (folder / "notes.txt").write_text("not a ticket")
    inner = folder / "inner"
    inner.mkdir()
    (inner / "c.json").write_text(json.dumps([{"id": "T-8"}]))
    return folder


def test_ticket_files(spark, ticket_folder):
    good, bad = tickets.read_tickets(spark, str(ticket_folder))
    rows = {r.document_id: r for r in tickets.ticket_documents(good, now=now()).collect()}
    assert len(rows) == 3 and bad.count() == 1
    one = rows["ticket_T-1"]
    assert one.content_text == (
        "Incident: Pool exhausted\n\nPriority: P1\n\nAffected Service: payments\n\nDescription:\nNo\nconnections from "
        "[REDACTED_IP_ADDRESS]\n\nError:\ntimeout\n\nResolution:\nRaised the size\n\nRoot Cause: slow query"
    )
    assert (one.title, one.service, one.priority, one.status, one.environment) == ("Pool  exhausted", "payments", "P1", "resolved", "staging")
    assert one.tags == ["db", "pool"] and one.metadata == {"root_cause": "slow query"}
    assert (one.last_modified - one.created_at).total_seconds() == 75 * 60
    assert one.word_count == len(one.content_text.split())
    three = rows["ticket_T-3"]
    assert three.content_text == "Incident: Disk, full" and three.tags == ["x,y"]
    (bare,) = [r for k, r in rows.items() if k not in ("ticket_T-1", "ticket_T-3")]
    assert bare.title == "Untitled Incident" and (bare.service, bare.environment) == ("unknown", "production")
    assert bare.content_text == "Description:\nonly text" and bare.created_at.timestamp() == NOW
    assert bare.document_id == "ticket_" + bare.content_hash[:16]
    counts = docs.ingest_counts(tickets.ticket_documents(good), bad).first()
    assert (counts.source_system, counts.ingested, counts.errors) == ("ticket_system", 3, 1)


def test_single_ticket_files_and_strict_text(spark, ticket_folder):
    good, _ = tickets.read_tickets(spark, str(ticket_folder / "a.json"))
    one = tickets.ticket_documents(good.where("id = 'T-1'"), strict=True).first()
    assert one.content_text.startswith("Incident: Pool exhausted Priority: P1 Affected Service: payments Description: No connections")
    assert tickets.read_tickets(spark, str(ticket_folder / "b.csv"))[0].count() == 1
    (ticket_folder / "c.csv").write_text("title,id\nSwapped,T-4\n")
    with pytest.raises(Exception, match="(?i)header"):
        tickets.read_tickets(spark, str(ticket_folder))[0].select("id", "title", "tags").collect()


def remote(spark, *records):
    rows = spark.createDataFrame([(json.dumps(r),) for r in records], "j string")
    return rows.select(F.from_json("j", schemas.REMOTE_TICKETS).alias("r")).select("r.*")


def test_remote_tickets(spark):
    full = {
        "sys_id": "s1", "number": "INC1", "short_description": "Down", "description": "d", "close_notes": "fixed", "category": "net",
        "u_service_name": "edge", "u_root_cause": "cable", "priority": {"display_value": "1 - Critical"},
        "state": {"display_value": "Resolved", "value": "6"}, "sys_created_on": "2023-11-10 08:00:00", "sys_updated_on": "2023-11-10 09:00:00",
    }
    old = {**full, "sys_id": "s2", "sys_created_on": "2023-01-01 00:00:00"}
    open_ = {**full, "sys_id": "s3", "state": {"display_value": "Open", "value": "2"}}
    bare = {"sys_id": "s4", "state": {"value": "6"}, "sys_created_on": "2023-11-11 00:00:00"}
    kept = tickets.resolved_since(remote(spark, full, old, open_, bare), 90, now())
    rows = {r.document_id: r for r in tickets.remote_ticket_documents(kept, now=now()).collect()}
    assert set(rows) == {"snow_s1", "snow_s4"}
    assert rows["snow_s1"].content_text == (
        "Incident: Down\n\nCategory: net\n\nPriority: 1 - Critical\n\nService: edge\n\nDescription:\nd\n\nResolution:\nfixed\n\nRoot Cause: cable"
    )
    assert rows["snow_s1"].metadata == {"number": "INC1", "state": "Resolved"}
    assert rows["snow_s1"].created_at.timestamp() == 1699603200
    # Labels stay without a value.
    assert rows["snow_s4"].content_text.startswith("Incident: \n\nCategory: \n\nPriority: ")
    assert rows["snow_s4"].last_modified.timestamp() == NOW


def test_text_files(spark, tmp_path):
    kb = tmp_path / "kb"
    (kb / "runbooks").mkdir(parents=True)
    (kb / "runbooks" / "db-pool.md").write_text("# Pool guide\n\nSteps.\n\n## Check\n\n```\n# not a heading really\n```\n")
    (kb / "runbooks" / "bad-bytes.txt").write_bytes(b"caf\xff token=abc")
    (kb / "outage.rst").write_text("Retrospective of the outage")
    (kb / "plain.md").write_text("no heading")
    (kb / "skip.docx").write_text("x")
    rows = {r.metadata["file_name"]: r for r in files.file_documents(files.read_text_files(spark, str(kb))).collect()}
    assert set(rows) == {"db-pool.md", "bad-bytes.txt", "outage.rst", "plain.md"}
    pool = rows["db-pool.md"]
    assert (pool.title, pool.document_type) == ("Pool guide", "runbook")
    assert pool.section_headings == ["Pool guide", "Check", "not a heading really"]
    assert pool.document_id == f"runbook_db-pool_{pool.content_hash[:6]}"
    assert pool.metadata["word_count"] == str(pool.word_count) and pool.language == "en"
    assert rows["bad-bytes.txt"].content_text == "caf� [REDACTED_API_KEY]"
    assert rows["bad-bytes.txt"].title == "Bad Bytes"
    assert rows["outage.rst"].document_type == "post_mortem"
    assert rows["plain.md"].document_type == "documentation"
    flat = files.file_documents(files.read_text_files(spark, str(kb), ("*.md",), recursive=False), strict=True).collect()
    assert [r.metadata["file_name"] for r in flat] == ["plain.md"]


def test_wiki_pages(spark, tmp_path):
    page = {"id": "7", "title": "Guide", "space_key": "OPS", "body": {"storage": {"value": "<h1>A</h1><p>b &amp; c</p><script>x</script>"}}, "_links": {"webui": "/x/7"}}
    lines = [page, {**page, "id": "8", "space_key": "HR"}, {**page, "id": "9", "_links": None}]
    (tmp_path / "pages.json").write_text("\n".join(map(json.dumps, lines)))
    rows = {r.document_id: r for r in wiki.wiki_documents(wiki.read_wiki_pages(spark, str(tmp_path / "pages.json")), "https://w", ["OPS"], now=now()).collect()}
    assert set(rows) == {"confluence_7", "confluence_9"}
    assert rows["confluence_7"].content_text == "A\nb & c" and rows["confluence_7"].document_type == "documentation"
    assert rows["confluence_7"].metadata == {"space_key": "OPS", "confluence_id": "7", "url": "https://w/wiki/x/7"}
    assert rows["confluence_9"].metadata["url"] == "https://w/wiki"


def test_alerts(spark):
    events = spark.sql("select 1L event_id, timestamp_ntz'2024-01-01 00:00:00' ts, 5L user_id, 'error' event_type, 1.5D value, '{}' props union all select 2L, null, 1L, 'click', 1D, ''")
    (row,) = alerts.alert_documents(events).collect()
    assert row.content_text == "Alert error fired. User 5 affected. Value 1.50 measured. Properties {}" and row.document_type == "alert"


def test_union_availability_and_emptiness(spark, tmp_path):
    found, warnings = docs.available(spark, {"here": str(tmp_path), "gone": str(tmp_path / "no")})
    assert list(found) == ["here"] and len(warnings) == 1
    with pytest.raises(ValueError):
        docs.union_sources()
    with pytest.raises(ValueError):
        docs.require_documents(spark.createDataFrame([], schemas.DOCUMENTS))


def test_json_round_trip(spark, ticket_folder):
    good, _ = tickets.read_tickets(spark, str(ticket_folder))
    before = tickets.ticket_documents(good, now=now())
    after = docs.from_json(docs.to_json(before))
    key = lambda r: r.document_id
    assert sorted(after.collect(), key=key) == sorted(before.collect(), key=key)
    odd = before.limit(1).withColumn("document_type", F.lit("memo"))
    assert docs.from_json(docs.to_json(odd)).first().document_type == "unknown"


def test_eval_samples_incidents_and_sinks(spark, tmp_path):
    (tmp_path / "eval.json").write_text(json.dumps([{"incident_id": "E1", "title": "t", "description": "d", "ground_truth_root_cause": "g"}]))
    row = inc.read_eval_samples(spark, str(tmp_path / "eval.json")).first()
    assert (row.service, row.priority, row.error_message) == ("", "P3", "")
    (tmp_path / "inc.json").write_text(json.dumps([{"incident_id": "I1", "title": "t", "description": "d"}, {"incident_id": "I2", "title": "t"}]))
    valid, rejected = inc.validate_incidents(inc.read_incidents(spark, str(tmp_path / "inc.json")))
    assert [r.incident_id for r in valid.collect()] == ["I1"]
    assert [(r.incident_id, r.reasons) for r in rejected.collect()] == [("I2", ["description is required"])]
    for fmt in ("json", "parquet"):
        inc.write_results(valid, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == 1
    with pytest.raises(ValueError):
        inc.write_results(valid, str(tmp_path / "x"), "pickle")
