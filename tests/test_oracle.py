"""Every registered query against its SQL on the smallest tables."""

import pytest

from rillscan.checks import oracle
from rillscan.checks.compare import compare
from rillscan.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SQL = oracle.sql()


def test_all_queries_have_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert compare(spark, SF, QUERIES[name], SQL[name]) == ""
