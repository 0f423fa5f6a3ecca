"""Two-engine differential test: every registered query against its DuckDB SQL.

Runs at sf0.001 in the suite (set BASKETLENS_ORACLE_SF to another directory to
check other scale factors; the driver runs sf0.01).
"""

import os

import pytest

from basketlens.plans import catalog, oracle
from tests.conftest import SF_SMALL
from tests.oracle_harness import compare, duck

SF = os.environ.get("BASKETLENS_ORACLE_SF", SF_SMALL)
NAMES = sorted(catalog.registry())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_oracle_sql():
    import __spark_entry__ as e
    assert set(NAMES) <= set(e.queries())
    assert set(NAMES) <= set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, con, name):
    df = catalog.registry()[name](spark, SF)
    problems, n_spark, n_duck = compare(df, con, oracle.SQL[name])
    assert not problems, problems


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["freq_band", "customers", "pct_customers", "total_revenue", "pct_revenue",
                          "avg_revenue_per_customer"]
    assert df.count() == 5


@pytest.fixture(scope="module")
def suite_tables(spark):
    from basketlens.sources.tables import RetailTables
    t = RetailTables.from_test_tables(spark, SF)
    t.persist_derived = True
    return t.stored()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb_over_materialized_tables(spark, con, suite_tables, name):
    """The same check with sources imported once and the shared grains materialized (bench suite mode)."""
    df = catalog.run(name, spark, SF, tables=suite_tables)
    problems, n_spark, n_duck = compare(df, con, oracle.SQL[name])
    assert not problems, problems
