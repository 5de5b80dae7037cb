"""The queries that SQL can express against their DuckDB equivalents."""

import compare
import pytest

from cadenza.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, con, name):
    assert compare.differences(spark, con, SF, queries.QUERIES[name], queries.ORACLE_SQL[name]) == []
