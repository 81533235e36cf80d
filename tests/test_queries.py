"""Every registered query of the observation operators against its SQL."""

import re

import pytest

from landstream import catalog
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert differences(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["assign_tile", "tiles_in_ellipse", "local_obs", "predict_obs", "temporal_stats", "clim_stats", "clim_percentiles", "five_number", "enkf_single_obs", "interp_bilinear"])
def test_native_plans(spark, sf_dir, name):
    """No Python, no products of all pairs: range joins are equi-joins on cells."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("BatchEvalPython|ArrowEvalPython|CartesianProduct|BroadcastNestedLoopJoin", plan)
