"""Every registered query on the smallest test tables, beside its SQL where it has one."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from compare import rows_of, sql_rows

import __spark_entry__ as entry_point
from runlore.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["query_id", "vec_id", "score", "rank"]
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "BatchEvalPython" not in plan
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        assert got == sql_rows(SF, SQL[name])
    else:
        assert got[0]


def test_approximate_recall_is_high(spark):
    rows = {r.cells: r.recall for r in QUERIES["approximate_recall"](spark, SF).collect()}
    assert rows["centroids"] >= 0.9 and rows["projections"] >= 0.9 and 0 < rows["labels"] <= 1


def test_bounds_leave_out_blocks(spark):
    rows = QUERIES["vector_blocks_skipped"](spark, SF).collect()
    assert all(0 <= r.scored <= r.pairs for r in rows)
    row = QUERIES["postings_blocks_skipped"](spark, SF).first()
    assert 0 < row.scored <= row.pairs


def test_learned_pairs_beat_coverage(spark):
    rows = {r.scorer: r.precision_at_1 for r in QUERIES["learned_pairs_precision"](spark, SF).collect()}
    assert rows["learned"] >= rows["coverage"]


def test_entry_without_the_corpus_subpackage(tmp_path):
    root = Path(entry_point.__file__).parent
    shutil.copytree(root / "runlore", tmp_path / "runlore", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in n)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_languages_are_told_apart(spark):
    rows = QUERIES["language_agreement"](spark, SF).collect()
    assert sum(r.agree for r in rows) >= 0.95 * sum(r.texts for r in rows)
