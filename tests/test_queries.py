"""Every registered query: against its SQL twin where it has one, otherwise that it yields rows."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
QUERIES, TWINS = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_equals_twin(spark, con, name):
    difference = compare(spark, con, FOLDER, name, QUERIES[name], TWINS[name])
    assert difference is None, difference


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_yields_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
