"""A registry of queries: each is a function of (spark, sf_dir), with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6
#: Exact halves would be rounded by chance; this moves them to one side.
NUDGE = 1e-9


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, doubles: str = "", digits: int = DIGITS, early: bool = False):
        """Register a query under its function's name. Doubles are rounded on both sides; for the SQL, they are named.

        sql: of DuckDB; None if SQL can't say it. early: the query itself has its doubles go through round_double(), before its rows multiply.
        """

        def put(f: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(spark, sf_dir) if early else rounded(f(spark, sf_dir), digits)

            self.queries[f.__name__] = run
            if sql is not None:
                changes = ", ".join(f"round({c} + CAST({NUDGE} AS DOUBLE), {digits}) + 0 AS {c}" for c in doubles.split())
                self.oracles[f.__name__] = f"SELECT * REPLACE ({changes}) FROM ({sql})" if changes else sql
            return f

        return put


def round_double(c: Column, digits: int = DIGITS) -> Column:
    """As rounded(), for columns of very many rows."""
    return round_half_up(c + F.lit(NUDGE), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, with one zero; times without a zone, as the tables have them."""
    change = {"double": lambda c: F.round(c + F.lit(NUDGE), digits) + F.lit(0.0), "timestamp": lambda c: c.cast("timestamp_ntz")}
    return df.select(*(change.get(t, lambda c: c)(F.col(c)).alias(c) for c, t in df.dtypes))

