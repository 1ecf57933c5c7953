"""Every query with an oracle matches DuckDB on sf0.01 (the driver's gate)."""

import pytest

from tests.conftest import SF001
from tests.oracle import compare, duck

import __spark_entry__ as E

ORACLE = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, name, SF001, con)
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns[0] == "col"
