"""Every query of the library against its SQL."""

import pytest

from fieldroll.catalogue import ORACLE_SQL, QUERIES

from .compare import connection, duck_rows, spark_rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(duck, ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
