"""Every registered query agrees with its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from promptloom.plans import ORACLES, QUERIES
from tests.compare import oracle_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    names, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    expected_names, expected = oracle_rows(SF_DIR, ORACLES[name])
    assert names == expected_names
    assert rows == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
