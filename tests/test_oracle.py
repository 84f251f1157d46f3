"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from narrata import queries
from tests import oracle

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    oracle.check(queries.queries()[name](spark, sf), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() > 0


def test_entry_returns_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(SQL) <= set(e.queries())
