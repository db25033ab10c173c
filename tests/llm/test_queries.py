"""The registered queries, and the pipeline's stages on the smallest data."""

import os

import pytest

import corpus_pipeline
from tidewake.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")


def test_all_ten_are_registered_and_sql_has_queries():
    assert {int(n[2:].split("_")[0]) for n in queries()} == set(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
    assert len(corpus_pipeline.STAGES) == 5


@needs_data
def test_pipeline_stages_keep_the_columns_and_shrink(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.count())
        assert docs.columns == columns or name == "packing"
    assert seen[0] >= seen[1] >= seen[2] > 0 and seen[4] > 0
