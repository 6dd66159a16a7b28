"""Every registered query against its SQL."""

import oracle
import pytest

import __spark_entry__ as entry_points

SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, sf_dir, con, name):
    df = entry_points.queries()[name](spark, sf_dir)
    if name in SQL:
        assert oracle.compare(df, con, SQL[name]) is None
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry_points.entry(spark).count() == 25
