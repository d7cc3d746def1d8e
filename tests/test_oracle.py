"""Every registered query against its SQL, at sf0.001."""

import pytest
from oracle import connection, difference

from entityframe.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    assert difference(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["segment", "valid_orders", "total"]
    assert set(e.oracle_sql()) <= set(e.queries())
