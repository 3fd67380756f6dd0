import pytest

from rillscan.checks.compare import compare
from rillscan.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    assert compare(spark, SF, queries.QUERIES[name], queries.SQL[name]) == ""
