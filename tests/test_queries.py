"""Every registered query of the library against its SQL oracle on the smallest tables."""

import pytest

from conftest import SMALL, rows_of
from driftline import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    assert got.columns
    frame = got.toPandas()
    if name in SQL:
        assert rows_of(frame) == rows_of(duck.sql(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
