"""Every query with SQL gives the SQL's rows; the others give rows."""

import pytest
from oracle import connection, same

from tarnwell.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, sf, name):
    same(spark, con, QUERIES[name], ORACLE_SQL[name], sf)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
