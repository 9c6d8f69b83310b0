"""Every registered query runs on the smallest tables and equals its DuckDB oracle."""
import pytest

from seqforge.plans import catalog
from seqforge.plans.check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_registry_complete():
    q, o = catalog.queries(), catalog.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90
    assert set(q) == set(o)   # every query has an oracle


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, SF, name, catalog.queries()[name], catalog.oracle_sql().get(name))
    assert ok, msg
