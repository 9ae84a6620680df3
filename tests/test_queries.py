"""Every registered query runs and, where it has a SQL twin, gives its rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, sql_engine

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, name):
    fn = queries()[name]
    if name in SQL:
        ok, text = compare(spark, sql_engine(sf), fn, SQL[name], sf)
        assert ok, text
    else:
        assert fn(spark, sf).columns


def test_every_twin_has_a_query():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
