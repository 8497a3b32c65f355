"""Queries of the subpackage that SQL can say, against DuckDB."""

import pytest

from millrace.llm import registry
from tests.compare import connection, of_duckdb, of_spark


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert of_spark(registry.queries()[name](spark, sf_dir)) == of_duckdb(connection(sf_dir), registry.oracle_sql()[name])
