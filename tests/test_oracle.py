import __spark_entry__
import pytest
from codelode import catalog

from tests.parity import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, con, name):
    sql = catalog.oracle_sql().get(name)
    df = catalog.queries()[name](spark, SF)
    if sql is None:
        df.collect()
    else:
        assert compare(df, con, sql) is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
