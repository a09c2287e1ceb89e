"""Every registered query of the graph library against its DuckDB form."""

import pytest
from conftest import SMALL
from oracle import database, same_rows

from weftline.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, con, name):
    assert name in ORACLE_SQL
    same_rows(QUERIES[name](spark, SMALL), con, ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
