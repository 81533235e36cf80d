"""Registered queries of the observation operators, with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

from .plans import calendar, climatology, diagnostics, ensemble, observations, spatial, streams  # noqa: E402

for _module in (diagnostics, observations, calendar, spatial, climatology, ensemble, streams):
    QUERIES |= _module.R.queries
    ORACLES |= _module.R.oracles
