"""Every registered query with an oracle equals DuckDB on the driver tables (sf0.001)."""

import pytest

import __spark_entry__ as E
from adlens.plans import catalog as C
from oracle_compare import compare, duck

# the library's own queries; those of the training-data folder are tested beside it
ORACLES = C.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


def test_every_query_is_registered_with_a_callable():
    qs = C.queries()
    assert set(ORACLES) <= set(qs)
    assert all(callable(f) for f in qs.values())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, sf_small, name):
    assert compare(spark, con, name, C.queries()[name], ORACLES[name], sf_small)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "campaign_name" in df.columns


@pytest.mark.parametrize("name", sorted(set(C.queries()) - set(ORACLES)))
def test_rows_only_queries_run_with_stable_schema(spark, sf_small, name):
    a = C.queries()[name](spark, sf_small)
    b = C.queries()[name](spark, sf_small)
    assert a.schema == b.schema
    assert a.count() >= 0
