"""Landed record files: every line once whatever the ranges, and a stream that follows growing files."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.sources import records
from runlore.sources.records import Folder, Range, lines, read_records

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])


@pytest.mark.parametrize("data", [b"", b"\n", b"a\nbb\n\nccc", b"one line", b"x\r\ny\r\n", b"\n\n\nq\n", "ü\n\x85é\n".encode()])
@pytest.mark.parametrize("split", [1, 2, 3, 7, 100])
def test_every_line_is_of_one_range(tmp_path, monkeypatch, data, split):
    monkeypatch.setattr(records, "BLOCK", 2)
    (tmp_path / "a.jsonl").write_bytes(data)
    folder = Folder({"path": str(tmp_path), "split_bytes": split})
    got = [x for n, s in folder.sizes().items() for r in folder.ranges(n, 0, s) for x in lines(r)]
    want, at = [], 0
    for line in data.split(b"\n"):
        if line.strip():
            want.append((at, line.rstrip(b"\r")))
        at += len(line) + 1
    assert got == want


def test_files_of_a_folder(tmp_path):
    for name in ("a.jsonl", "sub/b.jsonl", "_c.jsonl", ".d.jsonl", "_sub/e.jsonl", "f.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}\n")
    assert list(Folder({"path": str(tmp_path)}).sizes()) == ["a.jsonl", "sub/b.jsonl"]
    assert list(Folder({"path": f"file:{tmp_path}/", "pathGlobFilter": "*.json"}).sizes()) == ["f.json"]
    assert list(lines(Range(str(tmp_path), "sub/b.jsonl", 0, 3))) == [(0, b"{}")]


def test_batch_of_many_tasks(spark, tmp_path):
    rows = [{"id": f"r{i}", "n": i} for i in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nno json\n{\"id\": 5")
    (tmp_path / "empty.jsonl").write_text("")
    good, bad = read_records(spark, str(tmp_path), SCHEMA, split_bytes=4096)
    assert good.rdd.getNumPartitions() > 10
    assert sorted((r.id, r.n) for r in good.collect()) == sorted((r["id"], r["n"]) for r in rows)
    assert sorted(r.value for r in bad.collect()) == ["no json", '{"id": 5']
    assert good.select("file", "position").distinct().count() == 3000
    (tmp_path / "none").mkdir()
    assert read_records(spark, str(tmp_path / "none"), SCHEMA)[0].count() == 0


def test_a_stream_follows_growing_files(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        good, _ = read_records(spark, str(folder), SCHEMA, stream=True)
        writer = good.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.n for r in spark.read.schema("n bigint").parquet(out).collect())

    (folder / "a.jsonl").write_text('{"id":"a","n":1}\n{"id":"b","n":2}\n{"id":"c",')
    assert run() == [1, 2]  # the last line has no end yet
    with (folder / "a.jsonl").open("a") as f:
        f.write('"n":3}\n{"id":"d","n":4}\n')
    (folder / "b.jsonl").write_text('{"id":"e","n":5}\n')
    assert run() == [1, 2, 3, 4, 5]
    assert run() == [1, 2, 3, 4, 5]
    batch, _ = read_records(spark, str(folder), SCHEMA)
    assert batch.agg(F.sum("n")).first()[0] == 15
