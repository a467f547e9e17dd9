"""The jobs end to end on a small folder of tickets and runbooks."""

import json

import pytest
from pyspark.sql import functions as F

from runlore.__main__ import main
from runlore.operators.language import language_profiles
from runlore.operators.vector_table import VectorTable
from runlore.sources.base import Alerts, TextFiles, TicketFiles, ingest, with_languages

TICKET = {
    "id": "T-1", "title": "Payments return 503", "description": "connection pool exhausted in the payments service " * 8,
    "service": "payments", "environment": "production", "priority": "P1", "root_cause": "connection pool exhausted",
    "created_at": "2024-01-15T10:30:00Z",
}
INCIDENT = {
    "incident_id": "I-1", "title": "Payments return 503", "description": "connection pool exhausted", "service": "payments",
    "environment": "production", "priority": "P1",
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "tickets").mkdir()
    (tmp_path / "files" / "runbooks").mkdir(parents=True)
    (tmp_path / "tickets" / "t.json").write_text(json.dumps([TICKET]))
    (tmp_path / "files" / "runbooks" / "disk.md").write_text("# Disk full\n\nClean the logs.\n")
    (tmp_path / "incidents.json").write_text(json.dumps([INCIDENT, {"incident_id": "I-2", "title": "no description"}]))
    sample = {**INCIDENT, "ground_truth_root_cause": "Connection pool exhausted"}
    (tmp_path / "eval.json").write_text(json.dumps([sample]))
    reply = {"root_causes": [{"hypothesis": "the connection pool exhausted itself", "confidence": 0.9}], "confidence_score": 0.8}
    (tmp_path / "replies.json").write_text(json.dumps({"incident_id": "I-1", "text": json.dumps(reply)}))
    return tmp_path


def test_index_prompts_diagnose_evaluate(spark, folder):
    at = lambda *p: str(folder.joinpath(*p))
    common = ["--index", at("index"), "--dimensions", "64"]
    build = ["index", *common, "--tickets", at("tickets"), "--files", at("files")]
    main(build)
    table = VectorTable(spark, at("index", "table"))
    assert table.read().count() == 2
    main(build)
    assert table.read().count() == 2 and table.commit().version == 0
    main([*build, "--rebuild"])
    assert table.read().count() == 2 and table.commit().version == 1
    main(["prompts", *common, "--incidents", at("incidents.json"), "--output", at("prompts")])
    (prompt,) = spark.read.json(at("prompts")).collect()
    assert prompt.incident_id == "I-1" and prompt.n_context == 1 and "Source: Payments return 503" in prompt.user_message
    main(["diagnose", *common, "--incidents", at("incidents.json"), "--replies", at("replies.json"), "--output", at("diagnoses")])
    (diagnosis,) = spark.read.json(at("diagnoses")).collect()
    assert diagnosis.confidence_score == 0.8 and diagnosis.retrieved_context_count == 1 and not diagnosis.requires_escalation
    main(["evaluate", *common, "--dataset", at("eval.json"), "--replies", at("replies.json"), "--output", at("metrics")])
    (metrics,) = spark.read.json(at("metrics")).collect()
    assert (metrics.config, metrics.accuracy, metrics.recall_at_3, metrics.samples) == ("Full System", 100.0, 100.0, 1)


def test_ingest_run(spark, folder):
    (folder / "tickets" / "bad.json").write_text("[{")
    read = ingest(spark, [TicketFiles(str(folder / "tickets")), TextFiles(str(folder / "files")), Alerts(str(folder / "none"))])
    assert len(read.warnings) == 1 and "Alerts" in read.warnings[0]
    got = {r.source_system: (r.ingested, r.errors) for r in read.counts.collect()}
    assert got == {"ticket_system": (1, 1), "local_files": (1, 0)}
    with pytest.raises(ValueError):
        ingest(spark, [Alerts(str(folder / "none"))])
    labelled = spark.createDataFrame([("en", "the disk is full and the logs"), ("de", "die Platte ist voll und der Rest")], "lang string, text string")
    found = with_languages(read.documents, language_profiles(labelled))
    assert found.columns == read.documents.columns and {r.language for r in found.collect()} <= {"en", "de"}
    assert found.where(F.col("content_text").contains("Clean the logs")).first().language == "en"
