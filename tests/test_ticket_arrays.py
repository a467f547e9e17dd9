"""Files of JSON arrays are cut by their size."""

import json

from pyspark.sql import functions as F

from runlore.queries import files


def test_arrays_are_bounded_and_hold_all_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ARRAY_CHARS", 500)
    rows = spark.range(200).select(F.col("id"), F.repeat(F.lit("ä"), 20).alias("text")).coalesce(1)
    files.write_arrays(rows, str(tmp_path / "arrays"))
    found = [json.loads(f.read_text()) for f in (tmp_path / "arrays").glob("*.json")]
    assert sorted(r["id"] for part in found for r in part) == list(range(200))
    assert len(found) > 10 and max(map(len, found)) < 20
