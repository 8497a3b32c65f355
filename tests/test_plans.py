"""Every registered query of the engine against its oracle, on the smallest fixture."""

import pytest

from millrace import plans
from tests.compare import connection, of_duckdb, of_spark

ORACLES = plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf_dir, con, name):
    df = plans.queries()[name](spark, sf_dir)
    if name in ORACLES:
        assert of_spark(df) == of_duckdb(con, ORACLES[name])
    else:
        assert df.collect() is not None
