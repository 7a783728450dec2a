"""Every registered query against the SQL that states its answer."""

import pytest

import __spark_entry__ as entry
from harness import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, data):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        assert compare(df, duck, ORACLES[name]) is None
    else:
        assert len(df.columns) > 0 and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
