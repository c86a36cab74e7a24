"""Every registered query against its SQL over the small test tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    frame = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert difference(frame, connection, SQL[name]) is None
    else:
        assert frame.count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
