"""Every query of the core that has SQL gives the same rows as it."""

import pytest

import __spark_entry__ as entry
from sieveline.plans import dataset_plans, experiment_plans, quality_plans, run_plans, source_plans, sqlsig_plans, surface_plans
from tests.helpers import DATA, same_as_sql

MODULES = (quality_plans, dataset_plans, experiment_plans, sqlsig_plans, surface_plans, source_plans, run_plans)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    same_as_sql(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    QUERIES[name](spark, DATA).collect()


def test_entry(spark):
    assert entry.entry(spark).columns == ["load_id", "column_name", "finding"]
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
