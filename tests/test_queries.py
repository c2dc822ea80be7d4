"""Registered queries against their SQL form on the smallest tables."""

import pytest

import oracle
from newsflow import catalog

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.all_queries(), catalog.all_oracles()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_sql_form_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got, want = oracle.compare(spark, con, SF_DIR, QUERIES[name], SQL.get(name))
    if want is not None:
        assert got == want
