"""Every registered query against its SQL at the smallest scale."""

import pytest

from tallyloom.plans import registry
from tests.duck import connection, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.SQL:
        same(df, con, registry.SQL[name])
    else:
        assert df.count() > 0


def test_sql_names():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
