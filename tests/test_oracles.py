"""Every registered query at the smallest scale beside its SQL."""

import pytest
from compare import check, duck

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert check(spark, con, name, QUERIES[name], SQL.get(name), SF) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["station", "date", "pm25", "roll7", "band"] and df.limit(1).count() == 1
