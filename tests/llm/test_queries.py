"""The registered queries over the smallest tables, against their SQL where it can say them."""

import pytest
from check_oracles import compare, oracle_connection

import corpus_pipeline
from logvane.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert compare(queries.QUERIES[name](spark, SF_DIR), con, queries.ORACLES[name]) is None


def test_one_query_for_each_operator():
    numbers = [int(name[2:].split("_")[0]) for name in queries.QUERIES]
    assert numbers == list(range(1, 14))


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_DIR)
        assert after.columns == columns, name
        after = after.cache()
        assert 0 < after.count() <= before, name
        docs, before = after, after.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
