"""Every registered corpus query on the smallest test tables, beside its SQL where it has one, and the pipeline."""

import os

import pytest
from compare import rows_of, sql_rows

import corpus_pipeline
from runlore.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
NATIVE = ("op2_", "op8_", "op10_")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "BatchEvalPython" not in plan
    if name.startswith(NATIVE):
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        assert got == sql_rows(SF, SQL[name])
    else:
        assert got[1]


def test_pipeline_keeps_rows_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = corpus_pipeline.run(spark, SF).collect()
    whole = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in pieces} <= whole and len(pieces) > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "ngram_join", "mixing", "packing"]


def test_stages_of_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.count() == 0
    assert corpus_pipeline.packing(spark, docs, SF).count() == 0
