"""The registered queries and the pipeline on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op")])
def test_query_returns_rows(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if "doc_id" in df.columns and name not in ("op6_decontaminate", "op13_lexical_search"):
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline_keeps_columns_until_the_last_stage(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    out = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(out) < n and all(r["round_trip"] for r in out)
    assert len({r["doc_id"] for r in out}) == len(out)
