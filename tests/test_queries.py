import pytest

from lodestone.plans import catalogue
from tests.oracle import SMALL, ask, same

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, name):
    same(catalogue.queries()[name](spark, SMALL).toPandas(), ask(SQL[name]))


def test_every_query_has_sql():
    assert set(SQL) == set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(catalogue.queries()) <= set(entry.queries())
