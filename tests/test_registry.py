import pytest

import __spark_entry__ as entry
from pathweave import queries

from conftest import same_rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    assert same_rows(queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["s", "o"]
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
