"""Every query with a DuckDB twin, at the smallest scale."""
import pytest

import __spark_entry__ as entry
from compare import compare, connect

TWINS = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_twins_name_queries():
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_twin(spark, folder, duck, name):
    assert compare(QUERIES[name](spark, folder), duck, TWINS[name]) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "total_sales" in df.columns
