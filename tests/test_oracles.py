"""Every query with a SQL twin against DuckDB (`ORACLE_SF` picks the tables)."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from verification.compare import compare, duck
from verification.oracles import ORACLES
from verification.queries import QUERIES

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, con, name):
    assert compare(spark, con, SF, name) == ""


def test_entry_and_twins(spark):
    assert entry(spark).limit(1).count() == 1
    assert set(QUERIES) == set(ORACLES)
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())
