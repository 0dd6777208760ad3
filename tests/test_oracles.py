"""Every registered query on the smallest tables, against its SQL where it has one."""

import pytest
from check_oracles import compare, oracle_connection

import __spark_entry__ as entry
from workload import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    if name in entry.oracle_sql():
        assert compare(df, con, entry.oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
