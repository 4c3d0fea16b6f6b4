"""Every registered query that has an SQL counterpart, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check_oracle import compare, connect, rows_of

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = con.execute(ORACLES[name])
    expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert compare(rows_of(df.columns, [tuple(r) for r in df.collect()]), expected) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 3
