"""Every query against its SQL on the smallest tables."""

import pytest

from tallyforge.queries import ORACLES, QUERIES

from .oracle import connect, duck_rows, spark_rows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    columns, _, rows = spark_rows(QUERIES[name](spark, DATA))
    if name in ORACLES:
        assert (columns, rows) == (duck_rows(con, ORACLES[name])[0], duck_rows(con, ORACLES[name])[2])
    else:
        assert columns
