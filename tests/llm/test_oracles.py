"""Every query of the operators beside its DuckDB statement, at the smallest scale."""
import pytest
from compare import compare, connect

from shelfcast.llm import oracles, queries


def test_names():
    assert set(oracles.ORACLES) <= set(queries.QUERIES)
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda x: int(x[2:].split("_")[0]))] == [f"op{i}" for i in range(1, len(queries.QUERIES) + 1)]


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_statement(spark, folder, name):
    assert compare(queries.QUERIES[name](spark, folder), connect(folder), oracles.ORACLES[name]) == ""
