"""Every query with a SQL twin gives the twin's rows."""

import pytest

from lodestory.plans import all_oracles, all_queries
from tests.compare import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_twin_gives_rows(spark, name):
    """Those are compared with plain versions elsewhere."""
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
