"""Every registered query against its SQL statement."""

import pytest

import __spark_entry__ as entry
from compare import compare

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def test_every_statement_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal(spark, folder, name):
    assert compare(spark, folder, QUERIES[name], ORACLE[name]) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["bucket", "requests", "errors", "p95"]
    assert df.count() > 0
