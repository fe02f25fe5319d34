import pytest
from compare import assert_same

from laneweave import catalog

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(catalog.queries()[name](spark, SF), ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
