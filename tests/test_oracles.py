"""Every query against its DuckDB equivalent on the smallest tables."""

import compare
import pytest

from cadenza.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    if name in registry.ORACLE_SQL:
        assert compare.differences(spark, con, SF, registry.QUERIES[name], registry.ORACLE_SQL[name]) == []
    else:
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
