"""Every query with SQL of its own, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import oracle_rows, spark_rows

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    assert spark_rows(entry.queries()[name](spark, SF)) == oracle_rows(entry.oracle_sql()[name], SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
