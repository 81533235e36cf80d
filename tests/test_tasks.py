"""Tasks follow the number of rows, so that the memory of one doesn't grow with the table."""

import pytest

from landstream.operators import ranges
from landstream.plans import climatology as C
from landstream.plans import diagnostics as Q


@pytest.fixture
def small_tasks(spark, monkeypatch):
    name = "spark.sql.adaptive.enabled"
    spark.conf.set(name, "false")
    monkeypatch.setattr(ranges, "TASK_ROWS", 500)
    yield
    spark.conf.set(name, "true")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_sums_by_tasks_of_rows(spark, sf_dir, small_tasks, monkeypatch):
    """Both experiments move once and their join's rows once; what sums the months of a tile moves nothing."""
    n = Q.size(spark, sf_dir)
    assert n > 4
    stats = Q.temporal_stats(spark, sf_dir)
    assert exchanges(stats) == 3
    assert stats.rdd.getNumPartitions() == n
    got = sorted(map(tuple, stats.select("tile", "species", "n").collect()))
    monkeypatch.setattr(ranges, "TASK_ROWS", 10**9)
    assert got == sorted(map(tuple, Q.temporal_stats(spark, sf_dir).select("tile", "species", "n").collect()))


def test_scaling_stats_move_rows_once(spark, sf_dir, small_tasks):
    """Daily sums and their copies for windows and for all species stay where their tile is."""
    for query in (C.scaling_stats, C.scaling_stats_combined):
        assert exchanges(query(spark, sf_dir)) == 1
